"""Document fingerprints: a canonical exact digest and grouping by it.

Canonical form: NFKC, case folding, NFKC again, and every run of white space as one blank, with none at the ends.
The fingerprint is the 128-bit xxHash of the form's UTF-8 bytes, in hex. Likeness of two fingerprints is 1 if
they are equal and the bytes of the two canonical forms are too, else 0: the digest is exact. exact_groups() groups by
fingerprint and compares the bytes of the canonical forms inside each bucket, so that a collision can't merge two texts.

Only texts whose fingerprint occurs more than once are moved for that, compressed. A bucket that holds over 1/HOT of
those texts (there are fewer than HOT of them) is dealt out in parts; one text of each form and part is then compared.

Defined cases: a null text is an empty text; rows that repeat a doc_id are ordered by text and grouped each; null
doc_ids come last in descending order, and a group of theirs alone has no id; one document alone is followed by itself;
other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import SIEVE, bitmap, tune, written

#: Bytes of text in a range of doc_id that one task takes, and the share of rows beyond which a bucket is dealt out.
RANGE_BYTES, HOT = 32 << 20, 1000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(form(text))


def form(text: str | None) -> bytes:
    return canonical(text).encode("utf-8", "surrogatepass")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, is_next, doc_id, text in partitions by bucket: buckets are ranges of doc_id, rows descend in them, and
    after them comes (is_next) the first document of the bucket below, or of the top bucket after the lowest.

    There is a bucket for each RANGE_BYTES of text, and a task for each bucket. The texts are shuffled once. The driver
    sees one id for each bucket, and those ids alone are broadcast."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ranges = rows.select("doc_id").where("doc_id is not null").repartitionByRange(n, "doc_id")
    cuts = [float(r[0]) for r in ranges.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("top")).select("top").collect()]
    bucketizer = Bucketizer(splits=[float("-inf"), *sorted({*cuts}), float("inf")], inputCol="key", outputCol="bucket", handleInvalid="keep")
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("bucket").cast("int") + 1)  # null ids are the lowest
    keyed = bucketizer.transform(rows.withColumn("key", F.col("doc_id").cast("double"))).withColumn("bucket", bucket)
    heads = sorted(((b, i) for b, i in keyed.groupBy("bucket").agg(F.max("doc_id")).collect()), reverse=True)
    follows = [(b, *heads[(k + 1) % len(heads)]) for k, (b, _) in enumerate(heads)]
    after = spark.createDataFrame(follows, "to int, bucket int, head long")
    first = (
        keyed.withColumnRenamed("doc_id", "id")
        .join(F.broadcast(after), (F.col("id").eqNullSafe(F.col("head"))) & (keyed["bucket"] == after["bucket"]))
        .select(F.col("to").alias("bucket"), F.lit(True).alias("is_next"), F.col("id").alias("doc_id"), "text")
    )
    both = keyed.select("bucket", F.lit(False).alias("is_next"), "doc_id", "text").unionByName(first)
    return both.repartitionById(len(cuts) + 2, F.col("bucket")).sortWithinPartitions("bucket", "is_next", F.col("doc_id").desc_nulls_last(), "text")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row is finished when the one after it is seen; a bucket ends with its first is_next row."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held = None  # bucket, doc_id, text, fingerprint
    for batch in batches:
        out: list[tuple] = []
        buckets, is_next, ids, texts = (batch.column(k) for k in range(4))
        for bucket, over, doc_id, text in zip(buckets.to_pylist(), is_next.to_pylist(), ids.to_pylist(), (t.as_py() for t in texts), strict=True):
            own = None
            if held is not None and held[0] == bucket:
                own = fingerprint(text)
                out.append(_finished(held, text, own))
            held = None if over else (bucket, doc_id, text, own if own is not None else fingerprint(text))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *(pa.string(),) * 3, pa.float64(), pa.float64()), strict=True)], names=names)


def _finished(held: tuple, after: str, after_print: str) -> tuple:
    _, doc_id, text, own = held
    n = len(text)
    edited = text[: n - n // 3] + after[: n // 3]
    edited_print = own if edited == text else fingerprint(edited)
    near = [float(own == other and (x == text or form(x) == form(text))) for other, x in ((edited_print, edited), (after_print, after))]
    return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, edited_print, *near


def op3(docs: DataFrame) -> DataFrame:
    tune(docs.sparkSession)
    if docs.select("doc_id").limit(1).isEmpty():
        return docs.sparkSession.createDataFrame([], f"{SCHEMA}, group_id long")
    prints = written(with_next(docs).mapInArrow(_run, SCHEMA), "prints")
    return with_groups(prints, docs)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id (the smallest doc_id with the same canonical text) of each row."""
    return with_groups(written(fingerprints(docs), "prints"), docs)


def with_groups(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """prints(doc_id, fingerprint, ...) of docs with group_id."""
    compared = _compared(prints, docs).groupBy(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__print")).agg(F.min("group_id").alias("group_id"))
    joined = prints.join(compared, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fingerprint") == F.col("__print")), "left")
    return joined.withColumn("group_id", F.coalesce("group_id", "doc_id")).drop("__id", "__print")


def _compared(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, group_id) of the rows whose fingerprint occurs more than once, and of some others."""
    spark = prints.sparkSession
    many = written(prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"), "many")
    total = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = {r[0]: -(-r[1] * HOT // total) for r in many.where(F.col("n") * HOT > total).collect()}  # fewer than HOT rows
    bits = bitmap(many.select(F.conv(F.substring("fingerprint", 1, 7), 16, 10).cast("long").alias("p")))
    sent = spark.sparkContext.broadcast((bits, hot))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = sent.value
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, (t.as_py() for t in batch.column(1)), strict=True):
                own = form(text)
                digest = xxhash.xxh3_128_hexdigest(own)
                place = int(digest[:7], 16) % SIEVE
                if bits[place >> 3] >> (place & 7) & 1:
                    out.append((doc_id, digest, (doc_id or 0) % hot.get(digest, 1), digest in hot, pack.compress(own)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["doc_id", "fingerprint", "part", "hot", "body"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(moved, "doc_id long, fingerprint string, part int, hot boolean, body binary")
    runs = rows.repartition("fingerprint", "part").sortWithinPartitions("fingerprint", "part", F.col("doc_id").asc_nulls_last())
    forms = written(runs.mapInArrow(_forms, FORMS), "forms")
    # of a bucket in parts, one text of each form and part: at most a few for each of at most 2 * HOT parts
    few = forms.where("body is not null").select("doc_id", "fingerprint", F.lit(0).alias("part"), F.lit(False).alias("hot"), "body", F.col("part").alias("of"), F.col("form").alias("of_form"))
    tops = few.repartition("fingerprint").sortWithinPartitions("fingerprint", F.col("doc_id").asc_nulls_last()).mapInArrow(_forms, f"{FORMS}, of int, of_form int")
    top = tops.select(F.col("fingerprint").alias("__print"), "of", "of_form", F.col("least").alias("top"))
    placed = forms.join(top, (F.col("fingerprint") == F.col("__print")) & (F.col("part") == F.col("of")) & (F.col("form") == F.col("of_form")), "left")
    return placed.select("doc_id", "fingerprint", F.when(F.col("hot"), F.col("top")).otherwise(F.col("least")).alias("group_id"))


FORMS = "doc_id long, fingerprint string, part int, hot boolean, form int, least long, body binary"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, fingerprint, part, hot, body, ...) in order of fingerprint, part and doc_id, with the number of the
    row's form among those of its bucket's part and the smallest doc_id of that form. The body goes on with the first
    row of a form, where the bucket is in parts."""
    unpack, key, forms = zstandard.ZstdDecompressor(), None, {}
    for batch in batches:
        found = []
        for doc_id, digest, part, hot, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if key != (digest, part):
                key, forms = (digest, part), {}
            own = unpack.decompress(body)
            fresh = own not in forms
            number, least = forms.setdefault(own, (len(forms), doc_id))
            found.append((number, least, body if hot and fresh else None))
        number, least, body = zip(*found, strict=True) if found else ((), (), ())
        names = [*batch.schema.names[:4], "form", "least", "body", *batch.schema.names[5:]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(number, pa.int32()), pa.array(least, pa.int64()), pa.array(body, pa.binary()), *batch.columns[5:]], names=names)
