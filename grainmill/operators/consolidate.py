"""Consolidation of session records: keep, discard, promote to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.scoring import score
from grainmill.operators.merge import last_writes, upsert
from grainmill.schema import Parameters

_P = Parameters()
STAGES = {"light": _P.light, "rem": _P.rem, "deep": _P.deep}


def scored(records: DataFrame, as_of: Column) -> DataFrame:
    return records.withColumn("score", score(as_of))


def kept(done: DataFrame, threshold: float) -> DataFrame:
    return done.filter(F.col("score") >= threshold)


def counters(done: DataFrame, threshold: float, sessions: DataFrame | None = None, promote: float = _P.promote) -> DataFrame:
    """One row: processed_sessions, consolidated, discarded and promoted records.

    Sessions that were asked for count as processed even if they have no records; without sessions, those of the records count.
    """
    keep = F.col("score") >= threshold
    rows = done if sessions is None else done.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    n = (rows if sessions is None else sessions).agg(F.count_distinct("session_id").alias("processed_sessions"))
    sums = rows.agg(
        F.count_if(keep).alias("consolidated"), F.count_if(~keep).alias("discarded"), F.count_if(keep & (F.col("score") >= promote)).alias("promoted"))
    return n.crossJoin(sums)  # one row each


def promotions(done: DataFrame, threshold: float = 0.0, promote: float = _P.promote) -> DataFrame:
    """Nodes made of the records that are kept and reach the promotion score, one per id.

    The id is made of session and time, so records may share one: the greatest score holds, then the greatest text. A null summary becomes the
    title "Memory"; full_content is the record as JSON.
    """
    good = done.filter((F.col("score") >= threshold) & (F.col("score") >= promote))
    rows = good.select(
        F.concat(F.lit("mem_"), F.coalesce("session_id", F.lit("unknown")), F.lit("_"), F.coalesce("ts", F.lit(""))).alias("id"),
        F.lit("Memory").alias("type"), F.lit("L2").alias("layer"), F.substring(F.coalesce("summary", F.lit("Memory")), 1, 100).alias("title"),
        F.substring(F.coalesce("content", F.lit("")), 1, 500).alias("summary"), F.to_json(F.struct("session_id", "ts", "content", "summary", "access_count")).alias("full_content"),
        F.col("score").alias("confidence"), F.lit("sleep_consolidation").alias("source"))
    return last_writes(rows, ["id"], ["confidence", "full_content"]).select(*rows.columns)


def consolidate(nodes: DataFrame, records: DataFrame, as_of: Column, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(nodes with the promoted records, counters)."""
    done = scored(records, as_of)
    return upsert(nodes, promotions(done, threshold), ["id"]), counters(done, threshold)
