"""Typed links: filters, neighbours and evidence of whole batches of nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.times import iso


def edges_where(edges: DataFrame, source_id: str | None = None, target_id: str | None = None, rel_type: str | None = None) -> DataFrame:
    """Edges that agree with every value given; an empty string counts as not given. Times come out as ISO text."""
    given = {"source_id": source_id, "target_id": target_id, "rel_type": rel_type}
    tests = [F.col(k) == v for k, v in given.items() if v]
    rows = edges.filter(reduce(lambda a, b: a & b, tests)) if tests else edges
    return rows.select("source_id", "target_id", "rel_type", iso(F.col("valid_from")).alias("valid_from"), iso(F.col("valid_until")).alias("valid_until"), "properties")


def related(edges: DataFrame, roots: DataFrame | None = None, rel_type: str = "RELATES_TO") -> DataFrame:
    """(id, related_id): outgoing links of one type, one step, of all nodes or of the roots (id)."""
    pairs = edges.filter((F.col("rel_type") == rel_type) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    out = pairs.select(F.col("source_id").alias("id"), F.col("target_id").alias("related_id")).distinct()
    return out.join(roots.select("id").distinct(), "id", "left_semi") if roots is not None else out


def trace(edges: DataFrame, max_depth: int = 3, roots: DataFrame | None = None, rel_type: str = "DERIVED_FROM") -> DataFrame:
    """(root, id, depth): the ancestors of each root (id; all targets if none are given) up to max_depth steps.

    depth is the shortest way; direct parents come out whatever max_depth is, and a root on a cycle can be its own ancestor. Each
    level is made distinct, so ways don't multiply, and cycles end with the bound. Null ends are no links.
    """
    pairs = (
        edges.filter((F.col("rel_type") == rel_type) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        .select(F.col("target_id").alias("child"), F.col("source_id").alias("parent")).distinct())
    level = pairs.select(F.col("child").alias("root"), F.col("parent").alias("id"))
    if roots is not None:
        level = level.join(roots.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    level = level.withColumn("depth", F.lit(1))
    found = level
    for depth in range(2, max_depth + 1):
        level = level.join(pairs, F.col("id") == F.col("child")).select("root", F.col("parent").alias("id")).distinct().withColumn("depth", F.lit(depth))
        found = found.unionByName(level)
    return found.groupBy("root", "id").agg(F.min("depth").alias("depth")) if max_depth > 1 else found
