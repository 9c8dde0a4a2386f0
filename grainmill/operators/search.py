"""Keyword search by BM25 over whole batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import fold_accents, stems
from grainmill.operators.merge import ranked
from grainmill.session import broadcast_if_small, cut

# Fixed parameters of the ranking formula.
K1, B = 1.2, 0.75
#: Different terms of all queries that are broadcast at most.
FEW_TERMS = 100_000
#: Terms of queries, and postings of nodes, that a task meets at once.
BLOCK, PIECE = 1 << 20, 1 << 19


@dataclass(frozen=True)
class Analyser:
    """How texts become terms: lower-case runs of a-z, anything else separates. Off by default: accents folded first, stop words
    (a list, or "english" for Spark's own) dropped, words cut to their stems."""

    fold: bool = False
    stop_words: str | tuple[str, ...] = ()
    stem: bool = False

    def terms(self, text: Column) -> Column:
        lower = F.lower(F.coalesce(text, F.lit("")))
        words = F.filter(F.split(fold_accents(lower) if self.fold else lower, "[^a-z]+"), lambda w: w != "")
        stop = StopWordsRemover.loadDefaultStopWords("english") if self.stop_words == "english" else list(self.stop_words)
        if stop:
            words = F.filter(words, lambda w: ~w.isin(stop))
        return stems(words) if self.stem else words


PLAIN = Analyser()


def analysed(nodes: DataFrame, how: Analyser = PLAIN) -> DataFrame:
    """(id, is_active, t, len): the terms of title and summary of each node and their number; a node without terms has none."""
    active = F.col("is_active") if "is_active" in nodes.columns else F.lit(True).alias("is_active")
    return nodes.select("id", active, how.terms(F.concat_ws(" ", "title", "summary")).alias("t")).withColumn("len", F.size("t"))


def postings(nodes: DataFrame, how: Analyser = PLAIN) -> DataFrame:
    """(id, term, tf, len) over title and summary; len is the number of tokens of the node. Nodes without tokens give no rows."""
    return analysed(nodes, how).select("id", "len", F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def corpus(nodes: DataFrame, how: Analyser = PLAIN) -> DataFrame:
    """One row (n, avgdl): all nodes count, inactive ones and those without tokens included."""
    return _size(analysed(nodes, how))


def _size(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def statistics(nodes: DataFrame, how: Analyser = PLAIN) -> DataFrame:
    """(term, df, total): nodes that hold a term and its occurrences."""
    return postings(nodes, how).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def _top(at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k places of the highest scores, best first; equal scores by place."""
    if len(at) > k:
        least = np.partition(score, len(at) - k)[len(at) - k]
        over, tie = np.flatnonzero(score > least), np.flatnonzero(score == least)
        keep = np.concatenate([over, tie[np.argsort(at[tie], kind="stable")[: k - len(over)]]])
        at, score = at[keep], score[keep]
    by = np.lexsort((at, -score))
    return at[by], score[by]


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5) / 1e6


class _Index:
    """Postings of some nodes by term. A node is its place among the ids in order, so that equal scores rank by place."""

    def __init__(self, ids: pa.Array, terms: pa.Array, parts: np.ndarray):
        names, words = ids.dictionary_encode(), terms.dictionary_encode()
        order = pc.sort_indices(names.dictionary, null_placement="at_start")
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        node, term = place[names.indices.to_numpy()], words.indices.to_numpy()
        by = np.lexsort((node, term))
        self.ids, self.terms, self.n = names.dictionary.take(order), words.dictionary, len(order)
        self.node, self.part = node[by], parts[by]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.terms)))])

    def common(self, terms: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """The sums of all nodes, and the nodes that hold any of the terms, in order."""
        sums, held = np.zeros(self.n), np.zeros(self.n, bool)
        for t, weight in terms:
            at = self.node[self.start[t] : self.start[t + 1]]
            sums[at] += weight * self.part[self.start[t] : self.start[t + 1]]
            held[at] = True
        return sums, np.flatnonzero(held)

    def rare(self, terms: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that hold any of the terms, in order, and their sums."""
        cuts = [slice(self.start[t], self.start[t + 1]) for t, _ in terms]
        if len(terms) == 1:
            return self.node[cuts[0]], terms[0][1] * self.part[cuts[0]]
        at, back = np.unique(np.concatenate([self.node[c] for c in cuts]), return_inverse=True)
        return at, np.bincount(back, np.concatenate([w * self.part[c] for c, (_, w) in zip(cuts, terms, strict=True)]), len(at))

    def best(self, queries: list[tuple[int, list[tuple[int, float]]]], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, places, scores): the best nodes of each query (its number, its terms and their weights), exactly.

        Queries that share their common terms are answered together: these are summed once over all nodes, and each query looks at the
        nodes that hold its rare terms, and at the best of the others, which have the common sum alone.
        """
        size = np.diff(self.start)
        often = size > max(64, self.n // 100)
        split = sorted(([x for x in terms if often[x[0]]], number, [x for x in terms if not often[x[0]]]) for number, terms in queries)
        shared = None
        for few, number, rare in split:
            if few != shared:
                shared, (sums, held) = few, self.common(few)
                plain = _rounded(sums[held])
                first, score = _top(held, plain, 8 * limit)
            if not rare:
                yield number, first[:limit], score[:limit]
                continue
            at, own = self.rare(rare)
            own = _rounded(sums[at] + own)
            if len(first) and (len(at) < limit or np.partition(own, len(at) - limit)[len(at) - limit] <= score[0]):
                rest, also = first, score
                new = ~np.isin(rest, at)
                if new.sum() < limit and len(rest) < len(held):  # at most len(at) of the best hold a rare term
                    rest, also = _top(held, plain, limit + len(at))
                    new = ~np.isin(rest, at)
                at, own = np.concatenate([at, rest[new][:limit]]), np.concatenate([own, also[new][:limit]])
            yield number, *_top(at, own, limit)


def bm25(nodes: DataFrame, queries: DataFrame, limit: int = 5, how: Analyser = PLAIN, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """(qid, id, score, rank): the best active nodes for each query (qid, text), any term sufficing; rank counts from 0.

    Statistics cover all nodes; inactive ones are dropped after scoring. Scores are rounded to 6 digits before ranking; equal ones rank
    by id. A term that a query repeats counts each time. Only postings of the queries' terms are counted, once; these terms are broadcast
    up to FEW_TERMS. Queries of the same terms are answered once. The nodes that hold a term of a query may be most of the table, so they
    never leave the task that finds them: blocks of queries meet pieces of nodes in a grid, and only the best of a meeting are shuffled.
    """
    words = queries.select("qid", how.terms(F.col("text")).alias("t")).filter(F.size("t") > 0)
    asks = words.groupBy("qid").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("t"))), " ").alias("key"))  # terms are a-z
    if how.stem:  # Python's work is done once
        asks = cut(asks)
    texts = cut(asks.select("key").distinct().withColumn("no", F.monotonically_increasing_id()))
    asked = cut(texts.select("no", F.explode(F.split("key", " ")).alias("term")).groupBy("no", "term").agg(F.count("*").alias("times")))
    t = analysed(nodes, how)
    if how.stem:
        t = cut(t)
    hits = cut(
        t.select("id", "is_active", "len", F.explode("t").alias("term")).join(broadcast_if_small(asked.select("term").distinct(), FEW_TERMS), "term", "left_semi")
        .groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"), F.max("is_active").alias("is_active")))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    size = F.broadcast(_size(t))  # one row
    idf = F.log10((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = asked.join(df, "term").crossJoin(size).select("no", "term", (idf * F.col("times")).alias("value"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    parts = hits.filter("is_active").crossJoin(size).select("id", "term", part.alias("value"))
    blocks, pieces = max(1, -(-asked.count() // block)), max(1, -(-hits.count() // piece))
    side = lambda key, many: F.pmod(F.xxhash64(key), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    kind = dict(nodes.dtypes)["id"]
    grid = (
        parts.select(every(blocks).alias("block"), side("id", pieces).alias("piece"), F.lit(None).cast("long").alias("no"), "id", "term", "value")
        .unionByName(weights.select(side("no", blocks).alias("block"), every(pieces).alias("piece"), "no", F.lit(None).cast(kind).alias("id"), "term", "value")))

    def meet(t: pa.Table) -> pa.Table:
        mine = t.column("no").is_valid()
        q, v = t.filter(mine).combine_chunks(), t.filter(pc.invert(mine)).combine_chunks()
        none = pa.table({"no": q.column("no").slice(0, 0), "id": v.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not q.num_rows or not v.num_rows:
            return none
        whole = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        index = _Index(whole(v.column("id")), whole(v.column("term")), v.column("value").to_numpy())
        q = q.set_column(q.column_names.index("term"), "term", pc.index_in(q.column("term"), value_set=index.terms))
        q = q.filter(q.column("term").is_valid()).sort_by([("no", "ascending"), ("term", "ascending")])
        asking: dict[int, list[tuple[int, float]]] = {}
        for no, term, weight in zip(*[q.column(c).to_pylist() for c in ("no", "term", "value")], strict=True):
            asking.setdefault(no, []).append((term, weight))
        found = [x for x in index.best(list(asking.items()), limit) if len(x[1])]
        if not found:
            return none
        numbers = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[1]) for x in found])
        return pa.table({"no": numbers, "id": index.ids.take(pa.array(np.concatenate([x[1] for x in found]))), "score": np.concatenate([x[2] for x in found])})

    best = grid.groupBy("block", "piece").applyInArrow(meet, f"no long, id {kind}, score double")
    order = [F.desc("score"), F.col("id")]
    return asks.join(texts, "key").join(ranked(best, ["no"], order, limit), "no").select("qid", "id", "score", "rank")
