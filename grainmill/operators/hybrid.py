"""Gated hybrid retrieval: keywords, then vectors where keywords are weak, fused by reciprocal rank."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators import graph, search, vectors
from grainmill.operators.merge import ranked
from grainmill.schema import Parameters
from grainmill.session import cut


def fuse(keyword: DataFrame, vector: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """(qid, id, rrf_score, fts_rank, vec_rank, rank) of two ranked lists (qid, id, rank), ranks from 0.

    An id gets 1 / (k + rank) from each list that has it. Equal sums keep the keyword order, then the vector order.
    """
    none = F.lit(None).cast("int")
    both = keyword.select("qid", "id", F.col("rank").alias("fts_rank"), none.alias("vec_rank")).unionByName(vector.select("qid", "id", none.alias("fts_rank"), F.col("rank").alias("vec_rank")))
    share = F.coalesce(1.0 / (k + F.col("fts_rank")), 1.0 / (k + F.col("vec_rank")))
    sums = both.groupBy("qid", "id").agg(F.round(F.sum(share), 6).alias("rrf_score"), F.min("fts_rank").alias("fts_rank"), F.min("vec_rank").alias("vec_rank"))
    order = [F.desc("rrf_score"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vec_rank"), F.col("id")]
    return ranked(sums, ["qid"], order, limit if limit is not None else 1 << 30)


def weak(queries: DataFrame, keyword: DataFrame, gate: float) -> DataFrame:
    """(qid) of the queries whose best keyword score is below the gate, or that found nothing."""
    best = keyword.groupBy("qid").agg(F.max("score").alias("best"))
    return queries.select("qid").join(best, "qid", "left").filter(F.coalesce("best", F.lit(0.0)) < gate).select("qid")


def hybrid(nodes: DataFrame, queries: DataFrame, p: Parameters = Parameters(), always_fuse: bool = False) -> DataFrame:
    """The top_k nodes of each query (qid, text, embedding) with their summaries and ranks.

    The keyword list is decided first and stored; the vector list is searched for the weak queries alone (always_fuse: for all).
    Both lists hold active nodes only. nodes is read three times: hand over a stored table, not a costly plan.
    """
    keyword = cut(search.bm25(nodes, queries, p.fts_limit))
    asking = queries if always_fuse else queries.join(weak(queries, keyword, p.gate), "qid", "left_semi")
    vector = vectors.search(nodes.filter("is_active").select("id", "embedding"), asking, p.vector_limit)
    top = fuse(keyword, vector, p.rrf_k, p.top_k)
    return top.join(nodes.filter("is_active").select("id", "title", "summary", "confidence"), "id")


def with_evidence(hits: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """hits with evidence_chain and related_nodes, sorted lists of ids (empty if none)."""
    roots = hits.select("id").distinct()
    chain = graph.trace(edges, max_depth, roots).groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("evidence_chain"))
    near = graph.related(edges, roots).groupBy("id").agg(F.array_sort(F.collect_set("related_id")).alias("related_nodes"))
    none = F.array().cast("array<string>")
    return (
        hits.join(chain, hits.id == chain.root, "left").drop("root").join(near, "id", "left")
        .withColumns({c: F.coalesce(c, none) for c in ("evidence_chain", "related_nodes")}))


def search_response(nodes: DataFrame, queries: DataFrame, limit: int = 5, edges: DataFrame | None = None, p: Parameters = Parameters()) -> DataFrame:
    """(qid, nodes, total): one row per query with the list of its hits in order and their number; 0 and an empty list without any.

    limit must lie in 1..20. With edges each hit has its evidence_chain and related_nodes.
    """
    if not 1 <= limit <= 20:
        raise ValueError("limit must lie in 1..20")
    hits = hybrid(nodes, queries, replace(p, top_k=limit))
    fields = ["id", "title", "summary", "confidence", "rrf_score", "fts_rank", "vec_rank"]
    if edges is not None:
        hits = with_evidence(cut(hits), edges, p.graph_max_depth)
        fields += ["evidence_chain", "related_nodes"]
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("nodes"))  # at most limit a query
    shape = F.transform("nodes", lambda n: F.struct(*[n[f].alias(f) for f in fields]))
    none = F.array().cast(hits.select(F.array(F.struct(*fields))).dtypes[0][1])
    return queries.select("qid").join(listed, "qid", "left").select("qid", F.coalesce(shape, none).alias("nodes")).withColumn("total", F.size("nodes"))
