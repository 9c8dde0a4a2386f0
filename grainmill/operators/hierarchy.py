"""Full hierarchies from parent-child links of unknown depth, by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.ids import clean_id, parent_ids
from grainmill.session import cut, together


def links(edges: DataFrame, dag_nodes: DataFrame, nodes: DataFrame, axioms: DataFrame, rel_type: str = "DERIVED_FROM") -> DataFrame:
    """Distinct (child, parent): rel_type rows of edges and all parents of dag_nodes, cleaned ids, both ends known."""
    raw = edges.filter(F.col("rel_type") == rel_type).select(clean_id(F.col("target_id")).alias("child"), clean_id(F.col("source_id")).alias("parent"))
    listed = dag_nodes.select(clean_id(F.col("id")).alias("child"), F.explode(parent_ids(F.col("parents"))).alias("parent"))
    known = nodes.select("id").unionByName(dag_nodes.select("id")).unionByName(axioms.select("id")).distinct()
    return (
        raw.unionByName(listed).filter("child is not null and parent is not null").distinct()
        .join(known.withColumnRenamed("id", "child"), "child", "left_semi")
        .join(known.withColumnRenamed("id", "parent"), "parent", "left_semi")
        .select("child", "parent")
    )


class Hierarchy:
    """Pointers of all nodes of a set of links (child, parent), in one table `ways` (node, up, rooted, depth[, path]).

    rooted: up is a root, and depth the length of the shortest way of at most 2^k links from it.
    otherwise: up isn't a root, and a way of exactly depth = 2^k links leads from it down to node.
    Each round joins the pointers with themselves, which doubles k and puts the path segments together. Rounds end when
    no new root was reached and no node lost its last open pointer: nodes whose ways up end lose it after log(depth)
    rounds, so those that still have one are on a cycle or below one.
    """

    def __init__(self, pairs: DataFrame, paths: bool = False):
        self.paths = paths
        self.links = cut(pairs.select("child", "parent").filter("child is not null and parent is not null").distinct())
        children = self.links.select(F.col("child").alias("c")).distinct()
        step = self.links.join(children, F.col("parent") == F.col("c"), "left").select(
            F.col("child").alias("node"), F.col("parent").alias("up"), F.col("c").isNull().alias("rooted"), F.lit(1).cast("long").alias("depth"))
        self.ways = cut(step.withColumn("path", F.array("up", "node")) if paths else step)
        self.rounds = 0
        before = None
        while True:  # the next round runs while this one is counted
            state, wider = together(self._state, lambda: cut(self._doubled()))
            if not state[0] or state == before:
                break
            before, self.ways, self.rounds = state, wider, self.rounds + 1

    def _state(self) -> tuple[int, int]:
        """Nodes that still have an open pointer, and roots reached."""
        open_nodes = F.count_distinct(F.when(~F.col("rooted"), F.col("node")))
        return tuple(self.ways.agg(open_nodes, F.count_if("rooted")).first())

    def _doubled(self) -> DataFrame:
        tail = F.slice("n.path", 2, F.greatest(F.size("n.path") - 1, F.lit(0)))  # the joint is in both segments
        path = [F.concat("u.path", tail).alias("path")] if self.paths else []
        low, high = self.ways.filter(~F.col("rooted")).alias("n"), self.ways.alias("u")
        longer = low.join(high, F.col("n.up") == F.col("u.node")).select("n.node", "u.up", "u.rooted", (F.col("n.depth") + F.col("u.depth")).alias("depth"), *path)
        both = self.ways.filter("rooted").unionByName(longer).groupBy("node", "up", "rooted")
        if self.paths:  # the least depth, then the least path
            return both.agg(F.min(F.struct("depth", "path")).alias("b")).select("node", "up", "rooted", "b.*")
        return both.agg(F.min("depth").alias("depth"))

    def unresolved(self) -> DataFrame:
        """(node): on a cycle or below one."""
        return self.ways.filter(~F.col("rooted")).select("node").distinct()

    def cycles(self) -> DataFrame:
        """(node): on a cycle of one link or more; among unresolved nodes alone, see on_cycles."""
        stuck = self.unresolved()
        inner = self.links.join(stuck.withColumnRenamed("node", "child"), "child", "left_semi").join(stuck.withColumnRenamed("node", "parent"), "parent", "left_semi")
        return on_cycles(inner)

    def _marked(self) -> tuple[DataFrame, DataFrame]:
        """Rooted ways of the nodes that aren't on a cycle, and one mark (node_id, root_id, depth) for each node on a cycle or below cycles alone."""
        on = self.cycles()
        rooted = self.ways.filter("rooted")
        free = rooted.join(on, "node", "left_anti").select(F.col("node").alias("node_id"), F.col("up").alias("root_id"), F.col("depth").cast("int").alias("depth"), *(["path"] if self.paths else []))
        mark = lambda df, name: df.select(F.col("node").alias("node_id"), F.lit(name).alias("root_id"), F.lit(-1).alias("depth"))
        below = self.unresolved().join(on, "node", "left_anti").join(rooted.select("node").distinct(), "node", "left_anti")
        return free, mark(on, "cycle").unionByName(mark(below, "below_cycle"))

    def roots_of(self) -> DataFrame:
        """(node_id, root_id, depth): one row per node and root that leads to it; on a cycle ('cycle', -1); below a
        cycle without any root ('below_cycle', -1). Roots themselves give no row; no links give no rows."""
        free, marks = self._marked()
        return free.select("node_id", "root_id", "depth").unionByName(marks)

    def paths_of(self) -> DataFrame:
        """(node_id, root_id, depth, path): a shortest path from each root, 'root/.../node'; equal lengths: the least. Nodes on a cycle
        or below cycles alone are marked as in roots_of, with path ''. Needs paths=True."""
        free, marks = self._marked()
        return free.withColumn("path", F.array_join("path", "/")).unionByName(marks.withColumn("path", F.lit("")))


#: Links whose cycles one task finds by itself; that many names take it some 100 MB.
FEW_LINKS = 500_000


def on_cycles(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node): the nodes of links (child, parent) that lie on a cycle of one link or more, with work in proportion to the links.

    Up to `few` links, counted first, are searched in one task. More are labelled by all: each node learns the least label of the nodes that lead to it and the least of those it leads to, itself included. The
    nodes of a cycle agree in both, so links between nodes that don't agree are dropped; a node whose two labels are the same
    is on a cycle with the node of that label. What is left is labelled anew, in another order, until no link remains.
    Labels are hashes, so their order has nothing to do with the links: a label leads to its node's own label, and these jumps
    bring the least label around a cycle in logarithmic rounds on average. Labels that aren't unique are drawn again.
    """
    links = cut(links.filter("child is not null and parent is not null").select("child", "parent").distinct())
    if links.limit(few + 1).count() <= few:
        return cut(links.coalesce(1).mapInArrow(_strong, "node string"))
    found = links.filter("child = parent").select(F.col("child").alias("node"))
    links = links.filter("child <> parent")
    seed = 0
    while not links.isEmpty():
        names = links.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
        label = cut(names.select("node", F.xxhash64(F.lit(seed), "node").alias("v")))
        seed += 1
        n, distinct = label.agg(F.count("*"), F.count_distinct("v")).first()
        if n != distinct:
            continue
        pairs = cut(
            links.join(label.select(F.col("node").alias("child"), F.col("v").alias("c")), "child").join(label.select(F.col("node").alias("parent"), F.col("v").alias("p")), "parent").select("c", "p"))
        state = _labels(pairs, label.select("v"))
        own = state.select("v", "above", "below")
        same = lambda end, name: own.select(F.col("v").alias(end), F.struct("above", "below").alias(name))
        met = own.filter("above = below").select("v")  # leads to its label's node and back; alone, if it is that node and keeps no link
        inner = cut(pairs.join(same("c", "x"), "c").join(same("p", "y"), "p").filter("x = y").select("c", "p", (F.col("x.above") == F.col("x.below")).alias("met")))
        ring = inner.filter("met").select(F.explode(F.array("c", "p")).alias("v")).distinct().join(met, "v", "left_semi")
        found = cut(found.unionByName(ring.join(label, "v").select("node")))
        left = inner.filter(~F.col("met"))
        links = cut(
            left.join(label.select(F.col("v").alias("c"), F.col("node").alias("child")), "c").join(label.select(F.col("v").alias("p"), F.col("node").alias("parent")), "p").select("child", "parent"))
    return found.distinct()


def _strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on cycles of the few links of one partition, by depth-first search."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    n = t.num_rows
    names = pa.chunked_array([*t.column("child").chunks, *t.column("parent").chunks]).combine_chunks().dictionary_encode()
    code = names.indices.to_numpy()
    child, parent = code[:n], code[n:]
    size = len(names.dictionary)
    order = np.argsort(parent, kind="stable")
    start = np.searchsorted(parent[order], np.arange(size + 1)).tolist()
    to = child[order].tolist()
    on = np.zeros(size, dtype=bool)
    on[child[child == parent]] = True
    index, low, at = [0] * size, [0] * size, start[:size]
    stacked = bytearray(size)
    stack: list[int] = []
    clock = 0
    for root in range(size):
        if index[root]:
            continue
        way = [root]
        while way:
            v = way[-1]
            if not index[v]:
                clock += 1
                index[v] = low[v] = clock
                stack.append(v)
                stacked[v] = 1
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not index[w]:
                    way.append(w)
                elif stacked[w]:
                    low[v] = min(low[v], index[w])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[v])
            if low[v] == index[v]:  # v and what lies above it on the stack lead to each other
                cut_at = len(stack) - 1
                while stack[cut_at] != v:
                    cut_at -= 1
                group = stack[cut_at:]
                del stack[cut_at:]
                for w in group:
                    stacked[w] = 0
                if len(group) > 1:
                    on[group] = True
    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(np.flatnonzero(on)))], ["node"])


def _labels(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, above, below): the least node that leads to v, and the least that v leads to, v included; pairs (c, p) of a child and its parent."""
    state = cut(nodes.select("v", F.col("v").alias("above"), F.col("v").alias("below"), F.lit(True).alias("moved")))
    ask = lambda df, key, who, up: df.select(F.col(key).alias("key"), F.col(who).alias("who"), F.lit(up).alias("up"))
    links = ask(pairs, "p", "c", True).unionByName(ask(pairs, "c", "p", False))
    while True:
        asked = links.unionByName(ask(state, "above", "v", True)).unionByName(ask(state, "below", "v", False))
        heard = asked.join(state.select(F.col("v").alias("key"), "above", "below"), "key").select(
            F.col("who").alias("v"), F.when(F.col("up"), F.col("above")).alias("above"), F.when(~F.col("up"), F.col("below")).alias("below"))
        mine = state.select("v", "above", "below", F.col("above").alias("old_above"), F.col("below").alias("old_below"))
        new = mine.unionByName(heard, allowMissingColumns=True).groupBy("v").agg(*[F.min(x).alias(x) for x in ("above", "below", "old_above", "old_below")])
        state = cut(new.select("v", "above", "below", ((F.col("above") < F.col("old_above")) | (F.col("below") < F.col("old_below"))).alias("moved")))
        if state.filter("moved").isEmpty():
            return state


def descendants(pairs: DataFrame) -> DataFrame:
    """(node_id, descendant_id, depth): every descendant of every node with the length of the shortest way.

    Ancestor pointers of exactly 2^k links extend the pairs known so far, so rounds are logarithmic in the depth. A node on a
    cycle is its own descendant.
    """
    step = cut(pairs.filter("child is not null and parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("up")).distinct())
    known, jump, reach, size = step.withColumn("depth", F.lit(1)), step, 1, -1
    while (now := known.count()) != size:
        size = now
        wider = jump.alias("n").join(known.alias("u"), F.col("n.up") == F.col("u.node")).select("n.node", "u.up", (F.col("u.depth") + reach).alias("depth"))
        wider = known.unionByName(wider).groupBy("node", "up").agg(F.min("depth").alias("depth"))
        further = jump.alias("n").join(jump.alias("u"), F.col("n.up") == F.col("u.node")).select("n.node", "u.up").distinct()
        known, jump = together(lambda: cut(wider), lambda: cut(further))
        reach *= 2
    return known.select(F.col("up").alias("node_id"), F.col("node").alias("descendant_id"), F.col("depth").cast("int").alias("depth"))
