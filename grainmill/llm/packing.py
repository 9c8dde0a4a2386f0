"""Filling containers of fixed capacity with neighbouring documents along a space-filling curve."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.bpe import VOCABULARY, encoder, ship, slices, spread
from grainmill.session import cut


@dataclass(frozen=True)
class Settings:
    """capacity: tokens of a container. hashed: width of the hashed document vectors; dims, bits: of the curve.
    block: neighbouring items that are packed together, so about as far along the curve as a container's documents lie apart;
    open_bins: containers that later blocks may still fill."""

    capacity: int = 2048
    hashed: int = 256
    dims: int = 4
    bits: int = 10
    block: int = 64
    open_bins: int = 64


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of unsigned coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curve:
    """Hashed token counts of a document, projected to few dimensions and turned into a place on the curve."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(11)
        self.s = s
        self.axes = rng.standard_normal((s.hashed, s.dims)) / np.sqrt(s.hashed)

    def key(self, ids: list[np.ndarray]) -> np.ndarray:
        s = self.s
        v = np.zeros((len(ids), s.hashed))
        for i, x in enumerate(ids):
            if len(x):
                h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                sign = 1 - 2 * (h >> np.uint64(40) & np.uint64(1)).astype(np.float64)
                v[i] = np.bincount((h >> np.uint64(50)).astype(np.int64) % s.hashed, weights=sign, minlength=s.hashed)
        v = np.sign(v) * np.log1p(np.abs(v))
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        p = (v / np.where(norm > 0, norm, 1)) @ self.axes * np.sqrt(s.hashed)
        # a projection of a unit vector is about normal: this curve spreads it over the grid
        share = 1 / (1 + np.exp(-1.702 * p * 1.0))
        return hilbert(np.minimum((share * (1 << s.bits)).astype(np.int64), (1 << s.bits) - 1), s.bits)


class Packer:
    """Bins of items that come in order of the curve; holds the bins still open and nothing else.

    Each block of neighbours is packed by best fit, longest first, into the bins still open; then all but the emptiest open_bins
    are closed. So an item shares its container with documents near it on the curve, and only a partition's last bins stay unfilled.
    """

    def __init__(self, s: Settings):
        self.s = s
        self.open: list[tuple[int, int]] = []  # (room, bin), sorted
        self.n = 0

    def fresh(self, n: int) -> np.ndarray:
        """Numbers of n new bins that are full at once."""
        self.n += n
        return np.arange(self.n - n, self.n)

    def add(self, sizes: np.ndarray) -> np.ndarray:
        """Bin of each item; sizes are at most the capacity."""
        s = self.s
        out = np.zeros(len(sizes), dtype=np.int64)
        for start in range(0, len(sizes), s.block):
            part = sizes[start : start + s.block]
            for i in np.argsort(-part, kind="stable").tolist():
                size = int(part[i])
                k = bisect_left(self.open, (size, -1))
                if k < len(self.open):
                    room, name = self.open.pop(k)
                else:
                    room, name = s.capacity, int(self.fresh(1)[0])
                out[start + i] = name
                if room > size:
                    insort(self.open, (room - size, name))
            self.open = self.open[-s.open_bins :]
        return out


def sized(documents: DataFrame, s: Settings = Settings(), vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, place): length in tokens and place on the curve; null and empty texts have length 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, curve = encoder(vocabulary), Curve(s)
        for whole in batches:
            for b in slices(whole, "text"):
                ids = e.encode(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int32()), pa.array(curve.key(ids))], ["doc_id", "n_tokens", "place"])

    rows = spread(ship(documents, vocabulary).select("doc_id", "text"), "doc_id")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens int, place long")


def containers(documents: DataFrame, s: Settings = Settings(), vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, doc_id, piece, start, n_tokens, rank): where each document's tokens go; rank is its place among its partition's documents along the curve.

    A document longer than a container fills whole containers with its first tokens, piece by piece; its rest is packed like any
    other item. No other document is split. Documents without tokens lie in a container too, with length 0. Repeated rows are
    packed as often as they occur. The sized items are written once, then sorted by range along the curve, with doc_id behind
    it, so that equal documents spread over partitions; each partition packs its own stretch, batch by batch.
    """
    items = cut(sized(documents, s, vocabulary))
    kind = dict(items.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, met = Packer(s), 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n_tokens").to_numpy().astype(np.int64)
            full, rest = n // s.capacity, n % s.capacity
            rows = np.flatnonzero((full == 0) | (rest > 0))
            whole = np.repeat(np.arange(len(n)), full)
            pieces = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
            row = np.concatenate([rows, whole])
            piece = np.concatenate([full[rows], pieces])
            ids = np.concatenate([packer.add(rest[rows]), packer.fresh(len(whole))]) + (b.column("part")[0].as_py() << 40)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids), b.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * s.capacity),
                pa.array(np.concatenate([rest[rows], np.full(len(whole), s.capacity)]).astype(np.int32)), pa.array(met + row)], ["container_id", "doc_id", "piece", "start", "n_tokens", "rank"])
            met += len(n)

    ranged = items.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id").withColumn("part", F.spark_partition_id().cast("long"))
    return ranged.mapInArrow(run, f"container_id long, doc_id {kind}, piece int, start long, n_tokens int, rank long")


def fill(packed: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row: containers, tokens, unused tokens and the share of the room that is used; spread: how many places along the
    curve the first and the last document of a container lie apart on average."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), (F.max("rank") - F.min("rank")).alias("spread"))
    sums = [F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.avg("spread"), 1).alias("spread")]
    return per.agg(*sums).withColumns({
        "unused": F.col("n_containers") * s.capacity - F.col("n_tokens"),
        "used_share": F.round(F.try_divide(F.col("n_tokens"), F.col("n_containers") * s.capacity), 6)})


def checks(packed: DataFrame, sizes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of what must hold: documents packed, and how many containers are overfull, documents have another number of tokens than
    sizes (doc_id, n_tokens) says, were split although they fit, or lie in pieces that don't follow each other."""
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.max("piece").alias("last"), F.max(F.abs(F.col("start") - F.col("piece") * s.capacity)).alias("off"))
    both = per.join(sizes.select("doc_id", F.col("n_tokens").alias("want")), "doc_id", "full")
    docs = both.agg(
        F.count("k").alias("n_documents"), F.count_if(~F.col("n").eqNullSafe(F.col("want"))).alias("n_changed"),
        F.count_if(F.col("k") > F.greatest(F.lit(1), F.ceil(F.col("n") / s.capacity))).alias("n_split"), F.count_if((F.col("last") + 1 != F.col("k")) | (F.col("off") > 0)).alias("n_gaps"))
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > s.capacity).alias("n_overfull"))
    return docs.crossJoin(over)  # one row each
