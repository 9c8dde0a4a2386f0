"""Exact cosine search for batches of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.merge import ranked
from grainmill.session import cut

#: Query vectors that are sent to every task at least, vectors that a task meets at once, and numbers that either may hold beyond that.
QUERY_BLOCK, PIECE, NUMBERS = 4096, 65_536, 1 << 22
#: Queries and vectors of one product, and pairs whose similarity is computed in double precision at once.
TILE, PAIRS = (1024, 4096), 1 << 16


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if a vector is null or all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search_one(vectors: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """(id, similarity) of the vectors most similar to one query; see search."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.size("embedding") == len(query))
    return rows.select("id", F.round(cosine(F.col("embedding"), q), 6).alias("similarity")).filter("similarity is not null and not isnan(similarity)").orderBy(F.desc("similarity"), "id").limit(limit)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have dim finite values, not all zero, and which rows those are."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return x[ok] / norm[ok, None], rows[ok]


def _best(names: pa.Array, q: np.ndarray, ids: pa.Array, embeddings: pa.Array, dim: int, limit: int) -> pa.RecordBatch:
    """The best of some vectors for each query; of equal ones those of the smallest ids.

    Products in single precision tell which pairs may be among the best so far, wherever their error lies; those are computed in double.
    """
    x, rows = _matrix(embeddings, dim)
    by = pc.sort_indices(ids.take(pa.array(rows)), null_placement="at_start").to_numpy()
    x, rows, k = x[by], rows[by], min(limit, len(rows))
    margin = 1e-6 + 2.4e-7 * (dim + 8)
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(q) if k else 0, TILE[0]):
        block = q32[a : a + TILE[0]]
        m = len(block)
        best, at = np.full((m, k), -np.inf), np.full((m, k), len(x))
        for b in range(0, len(x), TILE[1]):
            cos = block @ x32[b : b + TILE[1]].T
            least = best[:, -1]
            if b == 0 and k <= cos.shape[1]:
                least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k].astype(np.float64) - margin
            least = np.where(best[:, -1] >= 1, np.inf, least - margin)  # later ones could only tie
            i, j = np.nonzero(cos >= least.astype(np.float32)[:, None])
            for c in range(0, len(i), PAIRS):
                one, two = i[c : c + PAIRS], j[c : c + PAIRS] + b
                exact = np.round(np.einsum("nd,nd->n", q[a + one], x[two]), 6)
                new = exact > best[one, -1]
                one, two, exact = one[new], two[new], exact[new]
                touched = np.unique(one)
                if len(touched):
                    who = np.concatenate([np.repeat(touched, k), one])
                    what, value = np.concatenate([at[touched].ravel(), two]), np.concatenate([best[touched].ravel(), exact])
                    order = np.lexsort((what, -value, who))
                    starts = np.searchsorted(who[order], touched)
                    pick = order[starts[:, None] + np.arange(k)]
                    best[touched], at[touched] = value[pick], what[pick]
        i, j = np.nonzero(at < len(x))
        parts.append((i + a, at[i, j], best[i, j]))
    i, j, cos = (np.concatenate([p[n] for p in parts]) for n in range(3))
    return pa.RecordBatch.from_arrays([names.take(pa.array(i)), ids.take(pa.array(rows[j])), pa.array(cos)], ["qid", "id", "similarity"])


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together up to so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, rows - sum(x.num_rows for x in held)))
            b = b.slice(held[-1].num_rows)
            if sum(x.num_rows for x in held) == rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def search(vectors: DataFrame, queries: DataFrame, limit: int = 10, block: int | None = None, piece: int = PIECE) -> DataFrame:
    """(qid, id, similarity, rank) of the vectors (id, embedding) most similar to each query (qid, embedding), exactly.

    Null and zero vectors, and those of another length than most queries', are never found and never ask. Similarities are
    rounded to 6 digits before ranking; equal ones rank by id. Up to `block` queries (QUERY_BLOCK, or NUMBERS numbers if that is more) are sent
    to every task, and the vectors stay where they are read. More are met in a grid: each of the blocks of queries by each of the pieces of
    vectors is a task of its own, so no task holds more than a block and a piece, and each vector travels once per block. Only the best of a
    meeting are shuffled.
    """
    asked = queries.select("qid", "embedding").filter("embedding is not null")
    found = vectors.select("id", "embedding").filter("embedding is not null")
    kind, name = dict(asked.dtypes)["qid"], dict(vectors.dtypes)["id"]
    schema = f"qid {kind}, id {name}, similarity double"
    asked = cut(asked)
    sizes = asked.groupBy(F.size("embedding").alias("size")).count().collect()  # a row for each length
    n = sum(r["count"] for r in sizes)
    dim = max(sizes, key=lambda r: (r["count"], r["size"]))["size"] if sizes else 0
    if not n:
        return ranked(vectors.sparkSession.createDataFrame([], schema), ["qid"], [F.desc("similarity"), F.col("id")], limit)
    block = block or max(QUERY_BLOCK, NUMBERS // max(dim, 1))
    few = min(piece, max(1, NUMBERS // max(dim, 1)))
    if n <= block:
        block_of = asked.toArrow()  # at most one block
        sent = vectors.sparkSession.sparkContext.broadcast((block_of.column("qid").combine_chunks(), block_of.column("embedding").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            q, at = _matrix(q, dim)
            names = names.take(pa.array(at))
            for t in _pieces(batches, few):
                yield _best(names, q, t.column("id").combine_chunks(), t.column("embedding").combine_chunks(), dim, limit)

        best = found.mapInArrow(run, schema)
    else:
        blocks = -(-n // block)
        pieces = max(1, -(-found.count() // piece))
        side = lambda key, many: F.pmod(F.xxhash64(key), F.lit(many)).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        null_id, null_qid = F.lit(None).cast(name).alias("id"), F.lit(None).cast(kind).alias("qid")
        grid = (
            found.select(every(blocks).alias("block"), side("id", pieces).alias("piece"), null_qid, "id", "embedding")
            .unionByName(asked.select(side("qid", blocks).alias("block"), every(pieces).alias("piece"), "qid", null_id, "embedding")))

        def meet(t: pa.Table) -> pa.Table:
            mine = t.column("qid").is_valid()
            q, v = t.filter(mine).combine_chunks(), t.filter(pc.invert(mine)).combine_chunks()
            out = []
            if q.num_rows and v.num_rows:
                x, at = _matrix(q.column("embedding").combine_chunks(), dim)
                names = q.column("qid").combine_chunks().take(pa.array(at))
                for i in range(0, v.num_rows, few):
                    part = v.slice(i, few)
                    out.append(_best(names, x, part.column("id").combine_chunks(), part.column("embedding").combine_chunks(), dim, limit))
            return pa.Table.from_batches(out) if out else pa.table({"qid": q.column("qid").slice(0, 0), "id": v.column("id").slice(0, 0), "similarity": pa.array([], pa.float64())})

        best = grid.groupBy("block", "piece").applyInArrow(meet, schema)
    return ranked(best, ["qid"], [F.desc("similarity"), F.col("id")], limit)
