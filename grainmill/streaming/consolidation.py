"""Consolidation of session records as they arrive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.functions.scoring import score
from grainmill.functions.times import parsed
from grainmill.operators.consolidate import promotions
from grainmill.schema import Parameters


def scored_stream(records: DataFrame, as_of: Column) -> DataFrame:
    """A stream of records with their scores; as_of is fixed for the run, so a replay gives the same scores."""
    return records.withColumn("score", score(as_of))


def session_activity(records: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Records and mean length per session and window of event time; records later than `late` are dropped."""
    t = records.withColumn("at", parsed(F.col("ts")).cast("timestamp")).withWatermark("at", late)
    return t.groupBy(F.window("at", window), "session_id").agg(F.count("*").alias("n"), F.avg(F.length("content")).alias("mean_length"))


def consolidate_stream(records: DataFrame, folder: str, checkpoint: str, as_of: dt.datetime, threshold: float = 0.5, p: Parameters = Parameters()) -> StreamingQuery:
    """Write each batch's promoted nodes to folder/batch=N; a batch that is run again after a failure overwrites its own directory."""
    at = F.lit(as_of).cast("timestamp_ntz")

    def write(batch: DataFrame, n: int) -> None:
        promotions(batch, threshold, p.promote).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return scored_stream(records, at).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
