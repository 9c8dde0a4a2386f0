"""Queries of the general data problems: hierarchies, orphans, histories and snapshot changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import hierarchy, history, references, snapshots
from grainmill.session import cut, table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.links(table(spark, d, "edges"), table(spark, d, "dag_nodes"), table(spark, d, "nodes"), table(spark, d, "axioms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.Hierarchy(_links(spark, d)).roots_of()


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.Hierarchy(_links(spark, d), paths=True).paths_of()


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "dag_nodes"), table(spark, d, "axioms"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(p3_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.history(table(spark, d, "edges"), table(spark, d, "node_patches"))


def p5_satellites(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both satellites with their attributes and periods; the other satellite's attributes are null."""
    parts = []
    for name, rows in history.node_satellites(table(spark, d, "node_patches")).items():
        stamps = {"load_ts": history.stamp(F.col("at")), "until_ts": F.coalesce(history.stamp(F.col("until")), F.lit(""))}
        parts.append(history.in_periods(rows).withColumns({"satellite": F.lit(name), **stamps}).drop("at", "until", "digest"))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).withColumn("confidence", F.col("confidence").cast("double"))


def p5_appended(spark: SparkSession, d: str) -> DataFrame:
    """The rated satellite built of the patches up to the middle of the log, and then appended to; late patches are counted by id."""
    p = table(spark, d, "node_patches")
    middle = p.agg(F.expr("percentile_disc(0.5) within group (order by version)")).first()[0] or 0
    first = cut(history.node_satellites(p.filter(F.col("version") <= middle))["rated"])
    rows, late = history.append(first, p.filter(F.col("version") > middle), "rated")
    out = first.unionByName(rows).groupBy("id").agg(F.count("*").alias("n_rows"), F.max("version").alias("version"), F.max(F.struct("version", "summary")).alias("s"))
    n = late.groupBy("id").agg(F.count("*").alias("n_late"))
    return out.join(n, "id", "left").select("id", "n_rows", "version", F.col("s.summary").alias("summary"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the links' satellite with a value of their state; closing rows have none."""
    rows = history.edge_satellite(table(spark, d, "edges"))
    return rows.select(
        F.concat_ws("|", "source", "target", "rel").alias("entity_key"), history.stamp(F.col("at")).alias("load_ts"), F.col("digest").isNull().alias("closes"), F.get_json_object("state", "$.by").alias("author"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.changes(table(spark, d, "node_snapshots"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("snapshot_id", "change").agg(F.count("*").alias("n_ids"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_report, p5_found, p5_satellites, p5_appended, p5_links, p6_found, p6_counts)
}
