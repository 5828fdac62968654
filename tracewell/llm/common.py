"""What the corpus operators share: table reading, batch limits, shared tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at once; texts may be very long.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts fit a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can reach.

    Only where that setting is unset (tests, local mode) a folder of our own is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            base = chosen.get()
        else:
            base = tempfile.mkdtemp(prefix="tracewell-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, dictionary: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    dictionary: whether columns may be coded by one, which is of no use to hashes.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    schema = df.schema
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage, upon which Spark drops the shuffle files of finished jobs.

    Spark drops them once the driver has no reference to their plans any more, which it learns by a
    collection; by itself that may come only after several more such jobs have filled the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_fold(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
