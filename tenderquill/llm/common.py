"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the size, shingle and line rules: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale's rules for other letters."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only a driver that is its own executor (tests) may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tenderquill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Shuffle files of a written table go as soon as it is written; Arrow batches are small and end by bytes, too, so that long texts don't add up.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
#: Most rows of one long that are broadcast, 2 MB; more of them are joined by a shuffle.
BROADCAST_KEYS = 1 << 18


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tenderquill/{tag}-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose long `key` is among keys, a written table of distinct ones: without moving rows while the keys are few, counted first."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge"), key, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
