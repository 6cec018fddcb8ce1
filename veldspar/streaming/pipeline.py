"""Micro-batches: replayed files, event ids, exact de-duplication, watermarks with late policies, a dead-letter table
and an idempotent sink, as one foreachBatch function of Structured Streaming.

Spark's own watermark drops late rows one trigger later than the rule wanted here (late: event_time below the largest
event time seen, this batch included, less the lateness), so the rule is applied in the batch. State lives in tables in
the sink's folder: every batch overwrites its own partition, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "source string, partition int, offset long, event_id binary, event_time long, ingest_time long, schema_version int, payload binary"
POLICIES = ("recompute", "dlq", "drop")


def event_id(key=None):
    """16 bytes: of the key, or of source, partition and offset."""
    text = F.col(key).cast("string") if key else F.concat_ws("\x1f", "source", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def replay_files(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """JSON lines as a stream, so many files a batch (the rate limit)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


@dataclass
class Pipeline:
    """folder: where data/, ids/, marks/ and dlq/ are kept. lateness in the unit of event_time."""

    spark: SparkSession
    folder: str
    lateness: int = 0
    policy: str = "dlq"
    transform: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    valid: str | None = None

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"no such policy: {self.policy}")

    def watermark(self, before_batch: int) -> int | None:
        row = _kept(self.spark, f"{self.folder}/marks", "top long, batch_id long").where(F.col("batch_id") < before_batch).agg(F.max("top")).first()
        return row[0]

    def _put(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch_id}")

    def run_batch(self, batch: DataFrame, batch_id: int) -> None:
        """poll -> de-duplicate (in the batch, and against ids of earlier batches) -> watermark -> publish -> ids and marks."""
        batch = batch.withColumn("event_id", F.coalesce("event_id", event_id()) if "event_id" in batch.columns else event_id())
        seen = _kept(self.spark, f"{self.folder}/ids", "event_id binary, batch_id long").where(F.col("batch_id") < batch_id).select("event_id")
        fresh = batch.dropDuplicates(["event_id"]).join(seen, "event_id", "left_anti")
        top, before = batch.agg(F.max("event_time")).first()[0], self.watermark(batch_id)
        top = before if top is None else top if before is None else max(top, before)
        late = F.col("event_time") < F.lit((top if top is not None else 0) - self.lateness)
        bad = ~F.expr(self.valid) if self.valid else F.lit(False)
        marked = fresh.withColumn("__error", F.when(bad, "invalid").when(late & F.lit(self.policy != "recompute"), "late"))
        self._put(self.transform(marked.where("__error is null").drop("__error")), "data", batch_id)
        dead = marked.where("__error is not null" if self.policy == "dlq" else "__error = 'invalid'").withColumnRenamed("__error", "error")
        self._put(dead, "dlq", batch_id)
        self._put(fresh.select("event_id"), "ids", batch_id)
        if top is not None:
            self._put(self.spark.createDataFrame([(top,)], "top long"), "marks", batch_id)

    def start(self, stream: DataFrame, checkpoint: str):
        """The stream into run_batch; ends when all there is has been read."""
        return stream.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def data(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/data")

    def offsets(self) -> DataFrame:
        """(source, partition, offset): the last offset of each, whether its row was published or refused."""
        both = self.data().select("source", "partition", "offset").unionByName(self.dead_letters().select("source", "partition", "offset"))
        return both.groupBy("source", "partition").agg(F.max("offset").alias("offset"))

    def dead_letters(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/dlq")


def windowed(df: DataFrame, ts: str, size: str, slide: str | None = None, by: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """(by, start, n[, total]) over tumbling or sliding windows of a timestamp; on a stream, set a watermark before."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    more = [F.sum(value).alias("total")] if value else []
    return df.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), *more).select(*by, F.col("w.start").alias("start"), "n", *(["total"] if value else []))


def sessions(df: DataFrame, ts: str, gap: str, by: tuple[str, ...]) -> DataFrame:
    """(by, start, end, n) of rows no further apart than gap."""
    return df.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
