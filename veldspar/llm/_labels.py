"""Bounded samples of labelled rows for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a classifier is fitted on at most, and the longest text (in bytes) among them. Whole texts only.
TRAIN_ROWS, TRAIN_BYTES = 6000, 1 << 16


def remainder(doc_id: str, mod: int) -> Column:
    """crc32(doc_id as text) mod; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, rows: int = TRAIN_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `rows` labelled documents whose remainder isn't held_out, picked by a hash of doc_id.

    Null labels and ids are left out; a doc_id labelled more than once counts by its highest label."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", mod) != held_out))
    picked = usable.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y")).orderBy(F.xxhash64(F.col("__id"), F.lit(11)), "__id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).where(F.octet_length("__text") <= TRAIN_BYTES)
    got = own.join(F.broadcast(picked), "__id").collect()  # at most `rows` ids are broadcast
    got.sort(key=lambda r: (r["__id"], r["__text"]))
    return [r["__text"] for r in got][: 2 * rows], [r["__y"] for r in got][: 2 * rows]
