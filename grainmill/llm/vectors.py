"""The most similar vectors of every vector, by balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from grainmill.session import broadcast_if_small, cut


@dataclass(frozen=True)
class Settings:
    """k: neighbours a vector gets. mean_list: vectors a list holds on average, before replicas. Lists are in proportion to the
    vectors, up to most_lists (33 million vectors; beyond, lists grow), since every task holds the centroids (16 MB at most).

    The centroids are fitted on per_list vectors a list, at least least_sample and at most most_sample, chosen by hash; every vector is
    indexed and asks. store_ratio and probe_ratio: a vector is stored in, and asks, the lists whose centroid is at most so many times
    as far as its nearest one, at most `stores` and `probes` of them. tile: rows of a list that one task holds at once.
    """

    dim: int = 64
    k: int = 10
    mean_list: int = 512
    most_lists: int = 65_536
    per_list: int = 32
    least_sample: int = 16_384
    most_sample: int = 262_144
    store_ratio: float = 1.3
    stores: int = 8
    probe_ratio: float = 1.3
    probes: int = 21
    tile: int = 4096


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has dim finite values that aren't all zero; all else (null included) isn't indexed and doesn't ask."""
    v = F.col("embedding")
    return vectors.filter(
        (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of a list column whose rows are usable."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Lists:
    """Centroids of balanced lists, and a graph of two layers over them that is searched in memory.

    The upper layer has hubs, each linked to the centroids that count it among their UP nearest hubs. A search meets all hubs,
    opens the best of them, and meets the centroids they are linked to; the rows that open a hub meet its centroids in one product.
    """

    UP, OPEN = 4, 14

    def __init__(self, sample: np.ndarray, n_lists: int):
        self.centroids = self._merged(self._split(sample.astype(np.float32), n_lists))
        n = len(self.centroids)
        n_hubs = int(2 * np.sqrt(n)) if n >= self.FLAT else 0
        self.hubs = self._split(self.centroids, n_hubs) if n_hubs else None
        if n_hubs:
            near = np.concatenate([np.argpartition(-(self.centroids[i : i + 1024] @ self.hubs.T), self.UP - 1, axis=1)[:, : self.UP] for i in range(0, n, 1024)])
            order = np.argsort(near.ravel(), kind="stable")
            self.members = (order // self.UP).astype(np.int32)
            self.starts = np.searchsorted(near.ravel()[order], np.arange(len(self.hubs) + 1))

    #: So few centroids are met all: that costs less than choosing among them.
    FLAT = 2048

    @staticmethod
    def _split(x: np.ndarray, n_lists: int) -> np.ndarray:
        """Halve the sample again and again at the median between two means, so that a crowded region gets as many more lists."""
        rng = np.random.default_rng(7)
        done, todo = [], [(np.arange(len(x)), n_lists)]
        while todo:
            rows, parts = todo.pop()
            if parts <= 1 or len(rows) < 4:
                done.append(x[rows].mean(axis=0))
                continue
            own = x[rows]
            a, b = own[rng.choice(len(own), 2, replace=False)]
            for _ in range(6):
                side = own @ (a - b)
                left = side > np.median(side)
                if not left.any() or left.all():
                    left = np.arange(len(own)) % 2 == 0
                a, b = own[left].mean(axis=0), own[~left].mean(axis=0)
            side = own @ (a - b)
            order = np.argsort(side, kind="stable")
            here = parts // 2
            at = len(rows) * here // parts
            todo += [(rows[order[:at]], here), (rows[order[at:]], parts - here)]
        c = np.array(done, dtype=np.float32)
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        return c / np.where(norm > 0, norm, 1)

    @staticmethod
    def _merged(c: np.ndarray) -> np.ndarray:
        """One of each group of equal centroids (up to rounding): ties among them would take up the probes of every vector near them.

        Unit vectors with a cosine of at least 1 - 1e-6 differ by at most 1.5e-3 along any axis, so only neighbours along one are compared.
        """
        axis = np.random.default_rng(13).standard_normal(c.shape[1]).astype(np.float32)
        along = c @ (axis / np.linalg.norm(axis))
        order = np.argsort(along, kind="stable")
        c, along = c[order], along[order]
        keep = np.ones(len(c), dtype=bool)
        for i in range(0, len(c), 256):
            start = int(np.searchsorted(along, along[i] - 1.5e-3))
            equal = c[i : i + 256] @ c[start : i + 256].T >= 1 - 1e-6
            for j in np.flatnonzero(equal.sum(axis=1) > 1):
                keep[i + j] = not (equal[j, : i + j - start] & keep[start : i + j]).any()
        back = np.sort(order[keep])
        out = np.empty_like(c)
        out[order] = c
        return out[back]

    def nearest(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines), sorted, of the want nearest centroids of each row that the search meets."""
        n, m = len(self.centroids), len(x)
        want = min(want, n)
        if self.hubs is None:
            return self._top(np.broadcast_to(np.arange(n, dtype=np.int32), (m, n)), x @ self.centroids.T, want)
        opened = min(self.OPEN, len(self.hubs))
        hub = np.argpartition(-(x @ self.hubs.T), opened - 1, axis=1)[:, :opened]
        sizes = np.diff(self.starts)
        order = np.argsort(hub.ravel(), kind="stable")
        row, slot = np.divmod(order, opened)
        bounds = np.searchsorted(hub.ravel()[order], np.arange(len(self.hubs) + 1))
        # the best of each hub's centroids for each row that opens it; a centroid has at most UP hubs
        most = min(want, int(sizes.max()))
        ids = np.zeros((m, opened, most), np.int32)
        cos = np.full((m, opened, most), -4, np.float32)
        for h in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[h], bounds[h + 1])
            mine = self.members[self.starts[h] : self.starts[h + 1]]
            if not len(mine):
                continue
            near = x[row[part]] @ self.centroids[mine].T
            k = min(most, len(mine))
            best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(mine) else np.broadcast_to(np.arange(k), near.shape)
            ids[row[part], slot[part], :k] = mine[best]
            cos[row[part], slot[part], :k] = np.take_along_axis(near, best, axis=1)
        ids, cos = ids.reshape(m, -1), cos.reshape(m, -1)
        few = min(self.UP * want, cos.shape[1])
        ids, cos = self._top(ids, cos, few)
        by_id = np.argsort(ids, axis=1, kind="stable")
        again = np.zeros(ids.shape, bool)
        sorted_ids = np.take_along_axis(ids, by_id, axis=1)
        np.put_along_axis(again, by_id[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], axis=1)
        return self._top(ids, np.where(again, -4, cos), want)

    @staticmethod
    def _top(ids: np.ndarray, cos: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.argpartition(-cos, want - 1, axis=1)[:, :want] if want < cos.shape[1] else np.broadcast_to(np.arange(want), cos.shape)
        value = np.take_along_axis(cos, best, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        return np.take_along_axis(ids, np.take_along_axis(best, order, axis=1), axis=1), np.take_along_axis(value, order, axis=1)

    def choose(self, x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lists, stored, asked) of each row. A replica is left out if its centroid is nearer to one chosen before than to the row."""
        ids, cos = self.nearest(x, s.probes)
        far = np.sqrt(np.maximum(0, 2 - 2 * cos))
        least = far[:, :1] + 1e-6
        asked = (far <= least * s.probe_ratio) & (cos > -2)
        stored = np.zeros_like(asked)
        stored[:, 0] = True
        for j in range(1, ids.shape[1]):
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bd,bjd->bj", self.centroids[ids[:, j]], self.centroids[ids[:, :j]])))
            hidden = (stored[:, :j] & (between < far[:, j : j + 1])).any(axis=1)
            stored[:, j] = (far[:, j] <= least[:, 0] * s.store_ratio) & ~hidden & (stored[:, :j].sum(axis=1) < s.stores) & (cos[:, j] > -2)
        return ids, stored, asked | stored


def _fit(base: DataFrame, s: Settings) -> Lists:
    n = base.count()
    lists = max(1, min(s.most_lists, n // s.mean_list))
    size = min(s.most_sample, max(s.least_sample, s.per_list * lists))
    share = base.select("embedding", F.pmod(F.xxhash64("vid"), F.lit(1 << 30)).alias("h"))
    few = share.filter(F.col("h") < int((1 << 30) * min(1.0, size / max(n, 1)))).select("embedding").limit(size + size // 8).toArrow()
    sample = units(few.column("embedding").combine_chunks(), s.dim) if few.num_rows else np.ones((1, s.dim))
    return Lists(sample, max(1, min(lists, len(sample) // 4)))


def _index(vectors: DataFrame, s: Settings) -> tuple[DataFrame, GroupedData]:
    """(base, tiles) of vectors (id, embedding), ids unique.

    base: (vid, id, embedding, class) of the usable rows; class is the vid that stands for all rows with exactly that vector.
    tiles: (list, piece, asker, vid, half, stored, asks) of one row of each class, grouped by tile: its asking rows meet its
    stored ones, each asking row with all stored ones of its lists.
    """
    base = (
        usable(vectors.select("id", "embedding"), s.dim)
        .withColumns({"vid": F.monotonically_increasing_id(), "h": F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))}))
    base = cut(base)
    same = cut(base.groupBy("h").agg(F.min("vid").alias("class"), F.count("*").alias("n")).filter("n > 1").select("h", "class"))
    base = base.join(broadcast_if_small(same), "h", "left").select("vid", "id", "embedding", F.coalesce("class", "vid").alias("class"))
    lists = _fit(base.filter("vid = class"), s)  # copies aren't routed, so they shape no list
    index = base.sparkSession.sparkContext.broadcast(lists)  # at most most_lists centroids

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                x = units(b.column("embedding"), s.dim).astype(np.float32)
                ids, stored, asked = index.value.choose(x, s)
                r, c = np.nonzero(asked)
                half = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * s.dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x.astype(np.float16)))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r, c].astype(np.int32)), b.column("vid").take(pa.array(r)), pa.array(stored[r, c]), half.cast(pa.binary()).take(pa.array(r))],
                    ["list", "vid", "stored", "half"])

    routed = base.filter("vid = class").select("vid", "embedding").mapInArrow(route, "list int, vid long, stored boolean, half binary")
    sized = cut(routed)
    # A list that is longer than a tile is met in pieces: each piece of stored rows by each piece of asking rows.
    sizes = F.broadcast(sized.groupBy("list").agg(
        F.ceil(F.count_if("stored") / s.tile).cast("int").alias("pieces"), F.ceil(F.count("*") / s.tile).cast("int").alias("askers")))
    piece = lambda n: F.pmod(F.xxhash64("vid"), F.greatest(n, F.lit(1))).cast("int")
    placed = sized.join(sizes, "list")
    asks = placed.select("list", F.explode(F.sequence(F.lit(0), F.greatest(F.col("pieces"), F.lit(1)) - 1)).alias("piece"), piece(F.col("askers")).alias("asker"), "vid", "half",
                         (F.col("stored") & (piece(F.col("pieces")) == F.col("piece"))).alias("stored"), F.lit(True).alias("asks"))
    holds = (
        placed.filter("stored and askers > 1")
        .select("list", piece(F.col("pieces")).alias("piece"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("asker"), "vid", "half", F.lit(True).alias("stored"), F.lit(False).alias("asks"), piece(F.col("askers")).alias("own"))
        .filter("asker <> own").drop("own"))

    return base, asks.unionByName(holds).groupBy("list", "piece", "asker")


def _meetings(t: pa.Table, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking vids, stored vids, cosines) of a tile, block by block; a row doesn't meet itself."""
    x = np.frombuffer(b"".join(t.column("half").to_pylist()), np.float16).reshape(-1, s.dim).astype(np.float32)
    vid = t.column("vid").to_numpy()
    stored = t.column("stored").to_numpy()
    have, names, who = x[stored], vid[stored], np.flatnonzero(t.column("asks").to_numpy())
    for i in range(0, len(who) if len(names) else 0, 512):
        q = who[i : i + 512]
        cos = x[q] @ have.T
        cos[vid[q][:, None] == names[None, :]] = -4
        yield vid[q], names, cos


def neighbours(vectors: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(base, near) of vectors (id, embedding), ids unique; base as in _index.

    near: (vid, near: array of (cos, vid)) with the k most similar other classes of each class, best first, from half-precision
    copies; exact copies are members of the same class and aren't listed. Unusable vectors and an empty table give no rows.
    """
    base, tiles = _index(vectors, s)

    def meet(t: pa.Table) -> pa.Table:
        """The k best stored rows for each asking row of one tile."""
        out_vid, out_n, out_cos, out_name = [], [], [], []
        for q, names, cos in _meetings(t, s):
            k = min(s.k, cos.shape[1])
            best = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(q), 1))
            value = np.take_along_axis(cos, best, axis=1)
            good = value > -4
            out_vid.append(q)
            out_n.append(good.sum(axis=1))
            out_cos.append(value[good])
            out_name.append(names[best][good])
        if not out_vid:
            return pa.table({"vid": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("cos", pa.float32()), ("vid", pa.int64())])))})
        ends = np.concatenate([[0], np.cumsum(np.concatenate(out_n))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(out_cos).astype(np.float32)), pa.array(np.concatenate(out_name))], ["cos", "vid"])
        return pa.table({"vid": pa.array(np.concatenate(out_vid)), "near": pa.ListArray.from_arrays(pa.array(ends), pairs)})

    met = tiles.applyInArrow(meet, "vid long, near array<struct<cos:float,vid:long>>")
    return base, met.groupBy("vid").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), asc=False), 1, s.k).alias("near"))


def links(vectors: DataFrame, least: float = 0.90, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(base, pairs): base as in _index; (a, b), a < b, of all classes that meet in some tile and have a cosine of at least `least`.

    Tiles hold half-precision copies, so pairs just below `least` are kept until the exact check in double precision. No list of
    a fixed length stands between: a class may have any number of partners.
    """
    base, tiles = _index(vectors, s)

    def meet(t: pa.Table) -> pa.Table:
        both = [np.zeros((2, 0), np.int64)]
        for q, names, cos in _meetings(t, s):
            i, j = np.nonzero(cos >= least - 0.005)
            a, b = q[i], names[j]
            both.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        a, b = np.unique(np.concatenate(both, axis=1), axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    pairs = tiles.applyInArrow(meet, "a long, b long").distinct()
    reps = base.filter("vid = class").select("vid", "embedding")
    both = pairs.join(reps.select(F.col("vid").alias("a"), F.col("embedding").alias("x")), "a").join(reps.select(F.col("vid").alias("b"), F.col("embedding").alias("y")), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            cos = np.einsum("ij,ij->i", units(t.column("x"), s.dim), units(t.column("y"), s.dim)) if t.num_rows else np.zeros(0)
            yield t.select(["a", "b"]).filter(pa.array(cos >= least - 1e-12))

    return base, both.mapInArrow(exact, "a long, b long")


def current(nodes: DataFrame) -> DataFrame:
    """(id, embedding) of the active current rows: of each id the row of the highest version; ids null don't count."""
    return (
        nodes.filter("id is not null").select("id", F.struct("version", "is_active", "embedding").alias("s"))
        .groupBy("id").agg(F.max("s").alias("s")).filter("s.is_active").select("id", F.col("s.embedding").alias("embedding"))
    )


def neighbour_lists(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(id, neighbour_id, similarity): the k most similar other rows of each row; of equal ones the smaller ids.

    Of a class of exact copies only the k + 1 smallest ids can be in any list, so no list of members is ever longer.
    """
    base, near = neighbours(vectors, s)
    first = Window.partitionBy("class").orderBy("id")
    few = base.select("class", "id").withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= s.k + 1).drop("rn")
    other = near.select(F.col("vid").alias("class"), F.explode("near").alias("n")).select("class", F.col("n.vid").alias("to"), F.col("n.cos").alias("similarity"))
    copies = base.groupBy("class").count().filter("count > 1").select("class", F.col("class").alias("to"), F.lit(1.0).cast("float").alias("similarity"))
    pairs = other.unionByName(copies).join(few.select(F.col("class").alias("to"), F.col("id").alias("neighbour_id")), "to")
    best = Window.partitionBy("class").orderBy(F.desc("similarity"), "neighbour_id")
    short = pairs.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= s.k + 1).drop("rn", "to")
    rows = base.select("class", "id").join(short, "class").filter("id <> neighbour_id")
    rank = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id")
    return rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= s.k).select("id", "neighbour_id", F.round(F.col("similarity").cast("double"), 3).alias("similarity"), F.col("rank").cast("int").alias("rank"))


def similar_pairs(vectors: DataFrame, least: float = 0.90, s: Settings = Settings()) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of rows with a cosine of at least `least` in double precision; see links. All pairs within a
    class of exact copies count too; similar_classes gives the same without them."""
    base, kept = links(vectors, least, s)
    member = base.select("class", "id")
    across = kept.join(member.select(F.col("class").alias("a"), F.col("id").alias("i")), "a").join(member.select(F.col("class").alias("b"), F.col("id").alias("j")), "b").select("i", "j")
    more = member.join(member.groupBy("class").count().filter("count > 1").select("class"), "class", "left_semi")
    m, o = more.alias("m"), more.alias("o")
    within = m.join(o, (F.col("m.class") == F.col("o.class")) & (F.col("m.id") < F.col("o.id"))).select(F.col("m.id").alias("i"), F.col("o.id").alias("j"))
    return across.unionByName(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def similar_classes(vectors: DataFrame, least: float = 0.90, s: Settings = Settings()) -> DataFrame:
    """(id, class_id, n_links): one row per usable row: its class of exact copies, called by the least id, and the number of other
    classes with a cosine of at least `least`."""
    base, kept = links(vectors, least, s)
    ends = kept.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    names = base.groupBy("class").agg(F.min("id").alias("class_id")).join(ends, "class", "left").select("class", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return base.select("id", "class").join(names, "class").select("id", "class_id", "n_links")
