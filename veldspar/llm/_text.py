"""Vectorised text kernels over Arrow buffers: whole texts, cut into words without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._spark import BLOCK_BYTES


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what the C library keeps of one stage's arrays would
    add to what the next stage needs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches anew, in blocks of about `most` bytes of that text column; no text is split. The outer loop of
    a kernel: at its end, freed memory is given back."""
    yield from cut(batches, column, most)
    give_back()


def cut(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """As blocks(), within a kernel."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            _, ends = buffers(batch.column(column).slice(at))
            n = max(1, int(np.searchsorted(ends[1:], most - size, side="right")))
            n = min(n, batch.num_rows - at)
            held.append(batch.slice(at, n))
            size += int(ends[n])
            at += n
            if size >= most or at < batch.num_rows:
                yield merged(held)
                held, size = [], 0
    if held:
        yield merged(held)


def merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the offsets of each text in them. A null is an empty text."""
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _table(word: np.ndarray) -> np.ndarray:
    """Byte -> 0 for a separator, else the byte with A-Z lowered."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[~word] = 0
    return out


_BYTES = np.arange(256)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lowered: ASCII letters and digits, and all above U+007F.
ALNUM = _table((_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)))
#: Words [^\x20\x09-\x0D]+ ; NUL is a word byte, so separators are told apart by SPACE_MASK.
SPACE_MASK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(inside: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes, none going over a text's end or one of cuts, and each text's first run."""
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    after |= edge[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """Made anew for each block: kept, they would be the largest thing that a worker holds."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64, out=out)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run: differences of one polynomial prefix sum, then a finaliser with the length."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(raw) + 1)[:-1], out=sums[1:])
    inverse = _powers(_P_INVERSE, len(raw) + 1)[starts]
    return fmix((sums[ends] - sums[starts]) * inverse + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every run of `words` words (a shorter text: of all its words) with A-Z lowered, with repeats.

    Returns the hashes, the offsets of each text in them, and the number of words of each text."""
    starts, ends, first = spans(~SPACE_MASK[raw], offsets)
    h = run_hashes(LOWER[raw], starts, ends)
    n_words = np.diff(first)
    counts = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    factors = fmix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    rolled = np.zeros(len(h), np.uint64)
    for k in range(words):
        rolled += padded[k : k + len(h)] * factors[k]
    at = np.repeat(first[:-1] - out_offsets[:-1], counts) + np.arange(out_offsets[-1])
    out = fmix(rolled[at])
    sizes = fmix(np.arange(words, dtype=np.uint64) + np.uint64(0xE7037ED1A0B428DB))
    for i in np.flatnonzero((n_words > 0) & (n_words < words)):
        own = h[first[i] : first[i + 1]]
        out[out_offsets[i]] = fmix((own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True) + sizes[len(own) : len(own) + 1])[0]
    return out, out_offsets, n_words
