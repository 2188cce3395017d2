"""Incremental ingest and event windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def new_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


#: Folders that a target's keys are dealt to, and the column that numbers a target's steps.
KEY_FOLDERS, STEP = 64, "ingest_step"


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # the first step: there is nothing yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append each micro-batch's rows whose keys the target hasn't got: a batch that runs again replaces its own step and adds nothing.

    Beside the target stands a narrow table of the keys, in folders by their hash; a batch reads the folders of its
    own keys and never the target's rows. Each step is a folder of its own, which a retry overwrites.
    """
    folder = F.pmod(F.xxhash64(*keys), F.lit(KEY_FOLDERS)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = transform(batch).dropDuplicates(keys)
        held = _written(spark, f"{target}_keys")
        if held is not None:
            own = [r[0] for r in rows.select(folder.alias("f")).distinct().collect()]  # at most KEY_FOLDERS numbers
            held = held.filter((F.col(STEP) != batch_id) & F.col("folder").isin(own))
            rows = store.new_rows(rows, held.select(*keys), keys)
        rows.write.mode("overwrite").parquet(f"{target}/{STEP}={batch_id}")
        added = spark.read.parquet(f"{target}/{STEP}={batch_id}").select(*keys, folder.alias("folder"))
        added.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{target}_keys/{STEP}={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, ts: str = "ts", width: str = "1 day", by: str = "event_type") -> DataFrame:
    w = events.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), by, "n", "total")


def user_sessions(events: DataFrame, ts: str = "ts", gap: str = "12 hours", by: str = "user_id") -> DataFrame:
    w = events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return w.select(by, "n", "first_ts", "last_ts")
