"""Structured Streaming: micro-batch upserts, late awards, drop folders, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import field_changes
from ..storage import new_path


def drop_folder(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", archive: str | None = None, per_trigger: int = 100) -> DataFrame:
    """Files as they arrive; processed ones move to archive."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def distinct_awards(stream: DataFrame, ref: str = "ref", at: str = "award_date", late: str = "62 days") -> DataFrame:
    """Each ref once, though sweeps read the last two months again."""
    return stream.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late).dropDuplicatesWithinWatermark([ref])


def windowed_counts(stream: DataFrame, at: str, width: str, *keys: str, late: str = "1 day") -> DataFrame:
    rows = stream.withColumn("event_time", F.col(at).cast("timestamp")).withWatermark("event_time", late)
    return rows.groupBy(F.window("event_time", width), *keys).agg(F.count("*").alias("n")).select("window.start", *keys, "n")


def upsert_stream(stream: DataFrame, table: str, changes: str, checkpoint: str, fields: list[str], key: str = "uid", order: str = "seq") -> StreamingQuery:
    """Keeps the latest row of each key in versions under table and appends changes, one version a batch.

    Replaying a batch writes the same version again, so a restart repeats no change.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(f"{table}/v={epoch - 1}") if epoch else batch.limit(0)
        except Exception:  # noqa: BLE001  a batch without rows leaves no version
            stored = batch.limit(0)
        touched = stored.join(batch.select(key).distinct(), key, "left_semi")
        rows = touched.unionByName(batch)
        moves = field_changes(rows, fields)
        moves.write.mode("overwrite").parquet(f"{changes}/v={epoch}")
        rest = [x for x in batch.columns if x != key]
        new = stored.unionByName(batch).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{table}/v={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """All available rows through the stream, written a version a batch to the shared folder; in complete mode the last version.

    A batch that is run again writes its version again, so a restart repeats nothing.
    """
    spark = stream.sparkSession
    folder = new_path(spark, f"stream-{tag}")
    last = [-1]

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v={epoch}")
        last[0] = epoch

    q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{folder}/v={last[0]}") if mode == "complete" else rows.option("recursiveFileLookup", "true").parquet(folder)
