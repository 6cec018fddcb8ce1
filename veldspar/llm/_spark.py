"""What the operators share on Spark's side: written tables in the shared folder, Arrow batch sizes, table readers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel takes at a time (one longer text makes a block of its own). A kernel holds
#: tens of times as much for its block, and two kernels run in each executor beside its JVM.
BLOCK_BYTES = 2 << 20
#: Rows and bytes of an Arrow batch on its way to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


#: Bits of a bitmap that sifts rows before they are shuffled.
SIEVE = 1 << 25


def bitmap(places: DataFrame) -> np.ndarray:
    """The places p (modulo SIEVE) that occur, as a bitmap of SIEVE bits: 4 MB on the driver, whatever the input."""
    at = F.pmod("p", F.lit(SIEVE))
    rows = places.select(at.alias("p")).groupBy(F.expr("p div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits")).collect()
    bits = np.zeros(SIEVE // 8, np.uint8)
    for part, held in rows:
        bits[part * 4096 : part * 4096 + len(held)] = np.frombuffer(held, np.uint8)
    return bits


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that very long texts don't pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. Only where it is unset, as in tests, a local one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = kept or f"file://{tempfile.mkdtemp(prefix='veldspar-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/veldspar/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table from written() that nothing needs any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
