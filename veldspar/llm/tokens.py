"""Token-ID output: documents as token ids in Parquet list columns, written in doc_id order and read back selectively.

Layout of a token table: rows (doc_id, part, first, n_tokens, tokens) in ascending doc_id over parts and within them;
`part` numbers the ranges of doc_id, of one or more files each, and `first` counts the ids of the part's earlier rows. Ids are dictionary-encoded (a page holds about two bytes an id
before compression), row groups and pages are kept small, and Parquet's page indexes allow a reader to fetch the
pages of a doc_id range only; metadata reads leave the token pages alone. A manifest beside it has, for each part,
the number of ids in all parts before it, so that `start` is known without touching a token.

Texts are cut at blanks, tabs and line ends, each of which the tokenizer drops, and between an ASCII letter and one
of .,;:!? on either side, where the tokenizer cuts as well; A-Z are lowered first, as the tokenizer does (not in a
block that holds a combining mark or a special token's beginning, where that could differ). Every distinct piece is
encoded once by the tokenizers library: pieces of printable ASCII and plain letters by its model alone, after the
tokenizer's own cuts, all others by the whole tokenizer. The ids of a text are those of its pieces, one after another.
(The tokenizer's normaliser and its split never look over such a cut, so this is exact; the tests compare with whole
texts.) A worker keeps its pieces from task to task.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows with a repeated doc_id are
ordered by text; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as X
from ._spark import new_path, tune

END_ID = 1
#: Distinct pieces that a worker remembers before it starts anew.
MEMORY = 1 << 19
LAYOUT = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "512", "parquet.enable.dictionary": "true"}
SCHEMA = "doc_id long, part int, first long, n_tokens long, tokens array<int>"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    """Ids of pieces of text by the tokenizers library, each distinct piece once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.values, self.ends = np.zeros(1 << 20, np.int32), np.zeros(MEMORY * 2, np.int64)
        self.values[0], self.ends[1], self.size = END_ID, 1, 1  # piece 0 is the end id

    def pieces(self, distinct: list[bytes]) -> np.ndarray:
        """The numbers of the pieces, after those not known yet have been encoded."""
        if self.size + len(distinct) > MEMORY:
            self.forget()
        new = [x for x in distinct if x not in self.known]
        for at in range(0, len(new), 4096):
            self._keep(new[at : at + 4096], [self._simple(x.decode()) for x in new[at : at + 4096]])
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def _simple(self, piece: str) -> list[int] | None:
        """The ids of a piece of printable ASCII and plain letters: cut as the tokenizer cuts it, its parts go to the
        tokenizer's own model. None for all else, which the whole tokenizer has to see."""
        if not piece.isascii() and not (_KNOWN(piece) and unicodedata.is_normalized("NFC", piece)):
            return None
        piece = piece.lower()
        if piece.isalpha():
            return self._word(piece)
        if "<|" in piece or not piece.isprintable():
            return None
        out: list[int] = []
        for part in _PARTS(piece):
            if not part.isascii() and not part.isalpha():
                return None
            out += self._word(part)
        return out

    def _word(self, part: str) -> list[int]:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return [x.id for x in self.model.tokenize(part)]

    def _keep(self, pieces: list[bytes], ids: list[list[int] | None]) -> None:
        other = [i for i, own in enumerate(ids) if own is None]
        if other:
            for i, e in zip(other, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in other], add_special_tokens=False), strict=True):
                ids[i] = e.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        while self.size + len(pieces) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        begin, many = self.ends[self.size], int(lengths.sum())
        self.ends[self.size + 1 : self.size + 1 + len(pieces)] = begin + np.cumsum(lengths)
        while begin + many > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[begin : begin + many] = np.fromiter(chain.from_iterable(ids), np.int32, many)
        self.known.update(zip(pieces, range(self.size, self.size + len(pieces)), strict=True))
        self.size += len(pieces)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text with the end id after them."""
        raw, offsets = X.buffers(texts)
        if b"<|" not in raw.tobytes() and not _MARK[raw].any():
            raw = X.LOWER[raw]
        inside = ~_CUT[raw]
        kind = _KIND[raw]
        starts, ends, first = X.spans(inside, offsets, np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1)
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw[inside])])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary())
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), b" ")[0].as_py()  # no piece holds a blank
        numbers = self.pieces(joined.split(b" ") if len(distinct) else [])
        piece = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
        piece = np.insert(piece, first[1:], 0)
        begin, lengths = self.ends[piece].astype(np.int32), (self.ends[piece + 1] - self.ends[piece]).astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ids = self.values[np.arange(upto[-1], dtype=np.int32) + np.repeat(begin - upto[:-1].astype(np.int32), lengths)]
        text_ends = upto[first + np.arange(len(first))]
        return pa.ListArray.from_arrays(pa.array(text_ends.astype(np.int32)), pa.array(ids))


_CUT = np.isin(np.arange(256), [32, 9, 10, 13])
#: 1 for ASCII letters, 2 for .,;:!? and a number whose sums never give 3 for the rest.
_KIND = np.full(256, 8, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = 2
#: First bytes of U+0300 to U+036F.
_MARK = np.isin(np.arange(256), [0xCC, 0xCD])

#: How the tokenizer cuts lower-case ASCII and plain letters. Plain letters are those up to Cyrillic without the two
#: whose lower case isn't one letter wherever they stand.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u052f]+|[0-9]|[^\\sa-z0-9\u00c0-\u052f]+").findall
_KNOWN = re.compile("(?:(?![\u0130\u03a3])[!-~\u00c0-\u052f])+").fullmatch
#: The letters that stand for bytes in the model's vocabulary: printable Latin-1 for itself, the rest from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}

_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> str:
    """Write the token table of docs(doc_id, text) and its manifest under path; returns path."""
    spark = docs.sparkSession
    tune(spark)
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done, part = encoder_of(tokenizer), 0, TaskContext.get().partitionId()
        for block in X.blocks(batches, 1):
            ids = encoder.encode(block.column(1))
            ends = ids.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(done + ends[:-1]), pa.array(np.diff(ends)), ids], names=["doc_id", "part", "first", "n_tokens", "tokens"])
            done += int(ends[-1])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(f"{path}/tokens")
    manifest(spark.read.schema(SCHEMA).parquet(f"{path}/tokens")).write.parquet(f"{path}/manifest")
    return path


def manifest(rows: DataFrame) -> DataFrame:
    """One row for each part: its ids and documents, and the number of ids in the parts before it (base)."""
    parts = rows.groupBy("part").agg(F.min("doc_id").alias("min_doc_id"), F.max("doc_id").alias("max_doc_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if wanted, tokens. Filters on doc_id reach the page indexes."""
    bases = spark.read.parquet(f"{path}/manifest").select("part", "base")
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", *(["tokens"] if tokens else []))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from rows that read_tokens() has read."""
    tune(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    return checksums(read_tokens(spark, write_tokens(docs, new_path(spark, "tokens"))))
