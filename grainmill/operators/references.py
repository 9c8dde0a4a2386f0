"""References to records that don't exist, are deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.ids import clean_id, parent_ids


def references(edges: DataFrame, dag_nodes: DataFrame) -> DataFrame:
    """All references, already gathered by (ref_table, ref_field, ref_id, period) with their earliest time.

    An id that is null or cleans to nothing refers to nothing and gives no row. period is the month, 'unknown' for
    a null time; the earliest time is enough to tell whether some reference of the period came before its target.
    The gathering runs map-side first, so an id with a third of all rows leaves each task as one row a month.
    """
    both = edges.select(
        F.lit("edges").alias("ref_table"), F.col("valid_from").alias("at"),
        F.explode(F.array(
            F.struct(F.lit("source_id").alias("f"), F.col("source_id").alias("i")),
            F.struct(F.lit("target_id").alias("f"), F.col("target_id").alias("i")),
        )).alias("r"),
    ).select("ref_table", F.col("r.f").alias("ref_field"), clean_id(F.col("r.i")).alias("ref_id"), "at")
    listed = dag_nodes.select(
        F.lit("dag_nodes").alias("ref_table"), F.lit("parents").alias("ref_field"),
        F.explode(parent_ids(F.col("parents"))).alias("ref_id"), F.col("mtime").alias("at"),
    )
    return (
        both.unionByName(listed).filter(F.col("ref_id").isNotNull())
        .withColumn("period", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")))
        .groupBy("ref_table", "ref_field", "ref_id", "period").agg(F.min("at").alias("earliest"))
    )


def validity(nodes: DataFrame, dag_nodes: DataFrame, axioms: DataFrame) -> DataFrame:
    """One row per known id: since when it exists (null: unknown or always) and whether its current row is deleted.

    The current row is that of the highest version; is_active null doesn't count as deleted.
    """
    rows = (
        nodes.select("id", F.col("created_at").alias("since"), F.struct(F.col("version"), F.col("is_active")).alias("state"), F.lit(False).alias("always"))
        .unionByName(dag_nodes.select("id", F.col("mtime").alias("since"), F.lit(False).alias("always")), allowMissingColumns=True)
        .unionByName(axioms.select("id", F.lit(True).alias("always")), allowMissingColumns=True)
    )
    return (
        rows.filter(F.col("id").isNotNull()).groupBy("id")
        .agg(F.min("since").alias("since"), F.max("state").alias("state"), F.max("always").alias("always"))
        .select("id", "always", F.when(~F.col("always"), F.col("since")).alias("since"), F.coalesce(~F.col("state.is_active"), F.lit(False)).alias("deleted"))
    )


def orphans(edges: DataFrame, nodes: DataFrame, dag_nodes: DataFrame, axioms: DataFrame) -> DataFrame:
    """Orphan references by table, field, id and month: missing, deleted or late.

    References and parents are hashed alike by id, sorted, and merged as two sorted streams (the merge join below);
    the parents' validity tells the three kinds apart. missing: the id isn't known. deleted: its current row is
    inactive. late: it first appears after some reference of the period; a null time on either side is never late,
    nor is an axiom. Empty tables give no rows; repeated rows count once.
    """
    refs = references(edges, dag_nodes)
    known = validity(nodes, dag_nodes, axioms)
    kind = (
        F.when(F.col("id").isNull(), "missing").when(F.col("deleted"), "deleted")
        .when(F.col("since") > F.col("earliest"), "late")
    )
    return (
        refs.join(known.hint("merge"), F.col("ref_id") == F.col("id"), "left")
        .withColumn("kind", kind).filter(F.col("kind").isNotNull())
        .select("ref_table", "ref_field", "ref_id", "period", "kind")
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan ids counted by table, field, period and kind."""
    return found.groupBy("ref_table", "ref_field", "period", "kind").agg(F.count("*").alias("n_ids"))
