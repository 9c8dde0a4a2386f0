import datetime as dt
import random
import time
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from grainmill.operators import hierarchy, history, neighbours, references, snapshots

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def _roots(pairs):
    parents, children = defaultdict(set), defaultdict(set)
    for c, p in pairs:
        parents[c].add(p)
        children[p].add(c)

    def below(x):
        far, todo = {}, deque((y, 1) for y in children[x])
        while todo:
            y, d = todo.popleft()
            if y not in far:
                far[y] = d
                todo.extend((z, d + 1) for z in children[y])
        return far

    nodes = set(parents) | set(children)
    far = {x: below(x) for x in nodes}
    cyc = {x for x in nodes if x in far[x]}
    out = {(x, "cycle", -1) for x in cyc}
    reached = set()
    for r in nodes - set(parents):
        for x, d in far[r].items():
            reached.add(x)
            if x not in cyc:
                out.add((x, r, d))
    return out | {(x, "below_cycle", -1) for x in parents if x not in cyc and x not in reached}


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_search(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(1, 60)}", f"n{rng.randrange(60)}") for _ in range(62)} | {(f"c{i}", f"c{i - 1}") for i in range(1, 12)}
    df = spark.createDataFrame([*pairs, (None, "x"), ("x", None)], "child string, parent string")
    h = hierarchy.Hierarchy(df, paths=True)
    assert {tuple(r) for r in h.roots_of().collect()} == _roots(pairs)
    links, roots = set(pairs), {(n, r, d) for n, r, d in _roots(pairs)}
    got = h.paths_of().collect()
    assert {(r["node_id"], r["root_id"], r["depth"]) for r in got} == roots
    for r in got:
        steps = r["path"].split("/")
        if r["depth"] < 0:
            assert r["path"] == ""
            continue
        assert len(steps) == r["depth"] + 1 and steps[0] == r["root_id"] and steps[-1] == r["node_id"]
        assert all((c, p) in links for p, c in zip(steps, steps[1:]))
    known = {(a, b): d for a, b, d in (tuple(r) for r in hierarchy.descendants(df).collect())}
    assert known[("c0", "c11")] == 11 and ("c11", "c0") not in known


def test_hierarchy_long_ring_below_a_root(spark):
    ring = [(f"r{(i + 1) % 9}", f"r{i}") for i in range(9)]
    pairs = ring + [("r0", "top"), ("leaf", "r8"), ("self", "self"), ("under", "self")]
    out = {tuple(r) for r in hierarchy.Hierarchy(spark.createDataFrame(pairs, "child string, parent string")).roots_of().collect()}
    assert out == _roots(set(pairs))
    assert ("leaf", "top", 10) in out and ("under", "below_cycle", -1) in out and ("self", "cycle", -1) in out


def test_a_large_ring_costs_no_more_than_its_links(spark):
    n = 100_000
    ring = spark.range(n).select(F.concat(F.lit("r"), ((F.col("id") + 1) % n).cast("string")).alias("child"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("parent"))
    more = spark.createDataFrame([("leaf", "r7"), ("leaf2", "leaf"), ("r9", "top"), ("apart", "top")], "child string, parent string")
    began = time.time()
    assert hierarchy.on_cycles(ring.unionByName(more), few=0).agg(F.count("*"), F.count_if(F.startswith("node", F.lit("r")))).first()[:] == (n, n)
    assert time.time() - began < 60
    out = hierarchy.Hierarchy(ring.unionByName(more.filter("parent <> 'top'"))).roots_of().groupBy("root_id").count().collect()
    assert {tuple(r) for r in out} == {("cycle", n), ("below_cycle", 2)}


@pytest.mark.parametrize("seed", [0, 1])
def test_cycles_against_search(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(rng.choice([60, 90, 130]))} | {(f"c{i}", f"c{i - 1}") for i in range(1, 20)} | {("c3", "c9"), ("d", "d")}
    df = spark.createDataFrame([*pairs, (None, "x")], "child string, parent string")
    got = {r["node"] for r in hierarchy.on_cycles(df).collect()}
    assert got == {r["node"] for r in hierarchy.on_cycles(df, few=0).collect()} == {n for n, r, _ in _roots(pairs) if r == "cycle"} and {"d", *(f"c{i}" for i in range(3, 10))} <= got
    assert hierarchy.on_cycles(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_hierarchy_empty(spark):
    e = spark.createDataFrame([], "child string, parent string, root string, depth int, path string")
    h = hierarchy.Hierarchy(e, paths=True)
    assert h.roots_of().count() == 0 and h.paths_of().count() == 0 and hierarchy.descendants(e).count() == 0


def test_links_clean_ids_and_drop_unknown(spark, got):
    edges = spark.createDataFrame([("`a`", " b", "DERIVED_FROM"), ("a", "zz", "DERIVED_FROM"), (None, "b", "DERIVED_FROM"), ("a", "c", "X"), ("--", "b", "DERIVED_FROM")], "source_id string, target_id string, rel_type string")
    dag = spark.createDataFrame([("p", "d", "['a', \"b\"] , a"), ("q", "d", None)], "path string, id string, parents string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    ax = spark.createDataFrame([], "id string")
    assert got(hierarchy.links(edges, dag, nodes, ax)) == [("b", "a"), ("d", "a"), ("d", "b")]


def _refs(spark):
    edges = spark.createDataFrame(
        [("a", "gone", T0), ("a", "gone", T0 + DAY), ("nope", "a", None), ("b", "a", T0 + 40 * DAY), ("late", "ax", T0), ("late", "a", T0 + 90 * DAY), (None, "", T0)],
        "source_id string, target_id string, valid_from timestamp_ntz")
    nodes = spark.createDataFrame(
        [("a", 1, True, T0 - DAY), ("gone", 1, True, T0 - DAY), ("gone", 2, False, T0), ("gone", 2, False, T0), ("late", 1, True, T0 + DAY), ("b", 1, None, None)],
        "id string, version int, is_active boolean, created_at timestamp_ntz")
    dag = spark.createDataFrame([("d", "[a, ghost, , ghost]", T0), ("d2", "d", T0 - DAY)], "id string, parents string, mtime timestamp_ntz")
    ax = spark.createDataFrame([("ax", "since")], "id string, since string")
    return edges, nodes, dag, ax


def test_orphans(spark, got):
    assert got(references.orphans(*_refs(spark))) == [
        ("dag_nodes", "parents", "d", "2023-12", "late"), ("dag_nodes", "parents", "ghost", "2024-01", "missing"),
        ("edges", "source_id", "late", "2024-01", "late"), ("edges", "source_id", "nope", "unknown", "missing"), ("edges", "target_id", "gone", "2024-01", "deleted")]


def test_orphans_of_empty_tables(spark):
    e, n, d, a = (x.limit(0) for x in _refs(spark))
    assert references.orphans(e, n, d, a).count() == 0
    assert references.orphan_report(references.orphans(_refs(spark)[0], n, d, a)).agg(F.sum("n_ids")).first()[0] > 0


def _snapshots(spark, extra=""):
    r = [("s1", "a", 1, "t"), ("s1", "b", 1, None), ("s1", "c", 1, "x"), ("s1", None, 1, "x"), ("s1", "", 1, "x"),
         ("s2", "a", 9, "t"), ("s2", "b", 1, ""), ("s2", "d", 1, "n"), ("s2", "d", 2, "m"), ("s3", "d", 1, "m"), ("s3", "a", 1, "t"), ("s3", "a", 1, "t"), (None, "q", 1, "q")]
    rows = [(s, i, "T", "L", t, None, 0.5, "src", v, True, None, T0, 7) for s, i, v, t in r]
    return spark.createDataFrame(rows, "snapshot_id string, id string, type string, layer string, title string, summary string, confidence float, source string, version int, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz, digest int")


@pytest.mark.parametrize("chunk", [1, 16])
def test_snapshot_changes(spark, got, chunk):
    assert got(snapshots.changes(_snapshots(spark), mean_chunk=chunk)) == [("s2", "b", "changed"), ("s2", "c", "removed"), ("s2", "d", "added"), ("s3", "b", "removed")]


def test_snapshot_changes_against_brute_force(spark):
    rng = random.Random(3)
    state, rows = {f"k{i:04d}": rng.random() for i in range(400)}, []
    all_states = []
    for s in range(3):
        state = {k: (rng.random() if rng.random() < 0.05 else v) for k, v in state.items() if rng.random() > 0.02} | {f"n{s}{i}": 1.0 for i in range(5)}
        all_states.append(dict(state))
        rows += [(f"s{s}", k, "T", "L", str(v), None, 1.0, "x", 1, True, None, None) for k, v in state.items()]
    df = spark.createDataFrame(rows, "snapshot_id string, id string, type string, layer string, title string, summary string, confidence float, source string, version int, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz")
    want = set()
    for n, (a, b) in enumerate(zip(all_states, all_states[1:]), 1):
        want |= {(f"s{n}", k, "added") for k in b.keys() - a.keys()} | {(f"s{n}", k, "removed") for k in a.keys() - b.keys()} | {(f"s{n}", k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert {tuple(r) for r in snapshots.changes(df).collect()} == want


def test_snapshots_empty(spark):
    assert snapshots.changes(_snapshots(spark).limit(0)).count() == 0


def _edges(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    r = [("a", "b", "R", h(0), h(5), '{"x": 1, "y": 2}'), ("a", "b", "R", h(0), None, '{"y":2,"x":1}'), ("a", "b", "R", h(5), None, '{"x":1,"y":2}'), ("a", "b", "R", h(9), h(3), '{"x":1,"y":3}'),
         ("a", "b", "R", h(12), h(13), '{"x":1,"y":3}'), ("a", "b", "R", h(20), None, '{"x":1,"y":3}'), ("a", "b", "S", h(0), None, "{}"), (None, "b", "R", h(1), None, None), ("a", "b", "R", None, None, "{}"),
         ("c", "d", None, h(0), None, None), ("c", "d", None, h(1), None, "not json")]
    return spark.createDataFrame(r, "source_id string, target_id string, rel_type string, valid_from timestamp_ntz, valid_until timestamp_ntz, properties string")


def _patches(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    r = [("n", 1, h(0), "t", None), ("n", 2, h(1), "t", None), ("n", 3, h(2), "u", None), ("n", 3, h(3), "v", None), ("n", 4, h(4), "v", ""), ("m", 1, h(0), "t", None), (None, 1, h(0), "t", None), ("n", None, h(9), "z", None)]
    return spark.createDataFrame([(i, v, t, "T", "L", x, s, 1.0, "src") for i, v, t, x, s in r], "id string, version int, patch_ts timestamp_ntz, type string, layer string, title string, summary string, confidence float, source string")


@pytest.mark.parametrize("hot", [1, 1000])
def test_history(spark, got, hot):
    t = lambda n: f"2024-01-01 {n:02d}:00:00.000000"
    clash = {c: F.lit("clash") for c in ("source", "at", "digest", "state", "versions", "_bucket")}
    edges = _edges(spark).withColumns(clash)
    patches = _patches(spark).withColumns({c: F.lit("clash") for c in ("at", "described", "rated", "until")})
    assert got(history.history(edges, patches, hot_rows=hot)) == [
        ("edge", "a|b|R", 1, t(0), t(9)), ("edge", "a|b|R", 2, t(9), t(13)), ("edge", "a|b|R", 3, t(20), ""),
        ("edge", "c|d|", 1, t(0), t(1)), ("edge", "c|d|", 2, t(1), ""),
        ("node", "n", 1, t(0), t(3)), ("node", "n", 2, t(3), t(4)), ("node", "n", 3, t(4), "")]


def test_satellites_hold_their_attributes(spark, got):
    sat = history.node_satellites(_patches(spark))
    assert got(sat["described"], "id", "version", "title", "type") == [("m", 1, "t", "T"), ("n", 1, "t", "T"), ("n", 3, "v", "T")]
    assert got(history.in_periods(sat["rated"]), "id", "version", "summary", "until") == [("m", 1, None, None), ("n", 1, None, T0 + dt.timedelta(hours=4)), ("n", 4, "", None)]
    rows = got(history.edge_satellite(_edges(spark)), "rel", "at", "state")
    assert ("R", T0, '{"x":1,"y":2}') in rows and ("R", T0 + dt.timedelta(hours=13), None) in rows and ("", T0 + dt.timedelta(hours=1), "raw:not json") in rows


@pytest.mark.parametrize("seed", [1, 2])
def test_appending_equals_building_anew(spark, got, seed):
    rng = random.Random(seed)
    rows = [(f"n{i}", v, T0 + DAY * v, "T", "L", rng.choice("ab"), rng.choice(["x", None]), rng.choice([0.5, 1.0]), "src") for i in range(12) for v in range(1, rng.randrange(2, 12))]
    p = spark.createDataFrame(rows, _patches(spark).schema)
    whole = history.node_satellites(p)
    for name in history.NODE_SATELLITES:
        have = history.node_satellites(p.filter("version <= 3"))[name]
        for low, high in ((3, 6), (6, 99)):
            new, late = history.append(have, p.filter(f"version > {low} and version <= {high}"), name)
            assert late.count() == 0
            have = have.unionByName(new)
        assert got(have) == got(whole[name])
        new, late = history.append(have, p.filter("version <= 2"), name)
        assert new.count() == 0 and late.count() == p.filter("version <= 2").count()
        assert [x.count() for x in history.append(have, p.limit(0), name)] == [0, 0] and history.append(have.limit(0), p, name)[0].count() == whole[name].count()


def test_history_of_empty_tables(spark):
    assert history.history(_edges(spark).limit(0), _patches(spark).limit(0)).count() == 0


def test_beside_agrees_with_and_without_buckets(spark, got):
    rng = random.Random(5)
    r = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(r, "k string, o int, v int")
    want = {"p": ("v", -1), "n": ("v", 1)}
    plain = neighbours.beside(df, ["k"], ["o"], want)
    cut = neighbours.beside(df, ["k"], ["o"], want, F.floor(F.col("o") / 17))
    assert got(plain) == got(cut)
