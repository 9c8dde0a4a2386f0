import datetime as dt
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill import session
from grainmill.functions import embedding, ids, markup, scoring, text, times
from grainmill.operators import consolidate, documents, graph, hybrid, merge, search, vectors
from grainmill.schema import NODES, PATCH, RECORDS, Parameters, empty
from grainmill.sources import storage
from grainmill.streaming import consolidation

NOW = dt.datetime(2024, 2, 1)


def ts(x):
    return F.lit(x).cast("timestamp_ntz")


def nodes(spark, rows):
    """rows: dicts of node columns."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in NODES) for r in rows], NODES)


EDGES = [("a", "b", "DERIVED_FROM"), ("b", "c", "DERIVED_FROM"), ("c", "d", "DERIVED_FROM"), ("d", "a", "DERIVED_FROM"), ("b", "d", "RELATES_TO"), (None, "a", "DERIVED_FROM")]


def edges(spark):
    return spark.createDataFrame([(*e, None, None, None) for e in EDGES], "source_id string, target_id string, rel_type string, valid_from timestamp_ntz, valid_until timestamp_ntz, properties string")


@pytest.mark.parametrize("depth,want", [(0, "c"), (1, "c"), (2, "bc"), (3, "abc"), (4, "abcd")])
def test_trace(spark, depth, want):
    roots = spark.createDataFrame([("d",), ("zz",)], "id string")
    assert "".join(sorted(r["id"] for r in graph.trace(edges(spark), depth, roots).collect())) == want


def test_related_and_filter(spark, got):
    assert got(graph.related(edges(spark))) == [("b", "d")]
    assert graph.edges_where(edges(spark)).count() == 6 and graph.edges_where(edges(spark), source_id="").count() == 6
    assert graph.edges_where(edges(spark), source_id="b", rel_type="RELATES_TO").count() == 1


def test_fusion_order(spark):
    lists = "qid string, id string, rank int"
    k = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 2)], lists)
    v = spark.createDataFrame([("q", "c", 0), ("q", "d", 1)], lists)
    out = hybrid.fuse(k, v).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["c", "a", "b", "d"] and out[0]["rrf_score"] == 0.032796


@pytest.mark.parametrize("best,opens", [(0.29, True), (0.30, False), (0.31, False), (None, True)])
def test_gate(spark, best, opens):
    q = spark.createDataFrame([("q",)], "qid string")
    k = spark.createDataFrame([("q", "a", best)] if best is not None else [], "qid string, id string, score double")
    assert (hybrid.weak(q, k, 0.3).count() == 1) is opens


def test_bm25_counts_inactive_nodes_in_its_statistics(spark):
    n = nodes(spark, [{"id": "a", "title": "Red fox", "is_active": True}, {"id": "b", "title": "red", "summary": "red dog", "is_active": False}, {"id": "c", "is_active": True}])
    q = spark.createDataFrame([("q", "red"), ("none", "zzzz"), ("null", None)], "qid string, text string")
    out = search.bm25(n, q).collect()
    assert [(r["qid"], r["id"]) for r in out] == [("q", "a")]
    idf, avg = np.log10((3 - 2 + 0.5) / 2.5 + 1), 5 / 3
    assert out[0]["score"] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg)), abs=1e-6)


def test_analyser(spark):
    words = "Élan of the Ñandú running; naïve cafés cafe\u0301"
    t = spark.createDataFrame([(words,), (None,)], "t string")
    terms = lambda how: [r[0] for r in t.select(how.terms(F.col("t"))).collect()]
    assert terms(search.Analyser())[0][:3] == ["lan", "of", "the"] and terms(search.Analyser())[1] == []
    assert terms(search.Analyser(fold=True, stop_words=("of", "the"))) == [["elan", "nandu", "running", "naive", "cafes", "cafe"], []]
    assert terms(search.Analyser(fold=True, stop_words="english", stem=True)) == [["elan", "nandu", "run", "naiv", "cafe", "cafe"], []]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("sky", "sky"), ("happy", "happi"), (
    "relational", "relat"), ("hopefulness", "hope"), ("adoption", "adopt"), ("controlling", "control"), ("oscillators", "oscil"), ("as", "as")])
def test_stems(word, stem):
    assert text.porter(word) == stem


def test_many_queries_meet_salted_terms(spark, monkeypatch):
    n = nodes(spark, [{"id": f"n{i:03d}", "title": f"red w{i % 7} fox{'es' * (i % 3)}", "is_active": i % 5 > 0} for i in range(80)])
    q = spark.createDataFrame([(f"q{i}", "red fox" if i % 2 else f"red w red {i}") for i in range(9)] + [("none", None)], "qid string, text string")
    want = sorted(map(tuple, search.bm25(n, q, 4).collect()))
    monkeypatch.setattr(search, "FEW_TERMS", 0)
    assert sorted(map(tuple, search.bm25(n, q, 4).collect())) == want and len(want) == 36
    assert search.bm25(n.limit(0), q).count() == 0 and search.bm25(n, q.limit(0)).count() == 0


def _shuffled(spark):
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _matching(spark):
    """Nodes and queries of which nearly every pair shares a term, and some a rare one."""
    n = nodes(spark, [{"id": f"n{i:03d}", "title": f"red w{chr(97 + i % 26)}{chr(97 + i % 23)} fox{'es' * (i % 3)}", "summary": "red cafés " * (i % 4), "is_active": i % 5 > 0} for i in range(400)])
    q = spark.createDataFrame([(f"q{i:03d}", f"{'Red ' * (1 + i % 2)}w{chr(97 + i % 26)}{chr(97 + i % 21)} fox{'es' * (i % 4)}") for i in range(400)] + [("none", "zzzz")], "qid string, text string")
    return n, q


def _scored(n, q, k, how):
    """Brute force: the best k of every query."""
    own = [(r["id"], r["is_active"], r["t"]) for r in search.analysed(n, how).collect()]
    avg, df, out = np.mean([len(t) for *_, t in own]), {}, []
    for *_, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    for qid, asked in q.select("qid", how.terms(F.col("text"))).collect():
        found = []
        for i, active, t in own:
            if active and set(asked) & set(t):
                part = [np.log10((len(own) - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in asked if w in t]
                found.append((-round(float(sum(part)), 6), i))
        out += [(qid, i, -s, r) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("how", [search.PLAIN, search.Analyser(fold=True, stop_words=("red",)), search.Analyser(fold=True, stop_words="english", stem=True)])
def test_matches_of_common_terms_stay_in_their_task(spark, how):
    n, q = _matching(spark)
    before = _shuffled(spark)
    got = sorted(map(tuple, search.bm25(n, q, 4, how).collect()))
    assert _shuffled(spark) - before < 40_000  # 128,000 pairs match
    want = _scored(n, q, 4, how)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)
    assert sorted(map(tuple, search.bm25(n, q, 4, how, 300, 500).collect())) == got


def test_equal_vectors_are_decided_where_they_are_read(spark):
    v = spark.createDataFrame([(f"v{i:03d}", [1.0, float(i % 2)]) for i in range(400)], "id string, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(f"q{i:02d}", [1.0, float(i % 2)]) for i in range(30)], "qid string, embedding array<float>")
    before = _shuffled(spark)
    out = {tuple(r) for r in vectors.search(v, q, 3).collect()}
    assert _shuffled(spark) - before < 1_000  # 6,000 pairs tie
    assert out == {(f"q{i:02d}", f"v{2 * r + i % 2:03d}", 1.0, r) for i in range(30) for r in range(3)}


HYBRID = {
    "always": lambda n, q: hybrid.hybrid(n, q, Parameters(top_k=20), True),
    "gated": lambda n, q: hybrid.hybrid(n, q),
    "wide": lambda n, q: hybrid.hybrid(n, q, Parameters(gate=2.0)),
    "evidence": lambda n, q: hybrid.with_evidence(hybrid.hybrid(n, q, Parameters(gate=2.0)), edges(q.sparkSession)),
    "response": lambda n, q: hybrid.search_response(n, q, 7).select("qid", F.posexplode("nodes").alias("rank", "x")).select("qid", "rank", "x.*")}


@pytest.mark.parametrize("name", HYBRID)
def test_hybrid_shuffles_no_pairs(spark, name):
    n, q = _matching(spark)
    place = F.substring("id", 2, 3).cast("int")
    n = n.withColumn("embedding", F.array(F.cos(place), F.sin(place)).cast("array<float>"))
    q = q.withColumn("embedding", F.array(F.lit(1.0), F.xxhash64("qid") % 7).cast("array<float>"))
    before = _shuffled(spark)
    got = HYBRID[name](n, q).collect()
    assert _shuffled(spark) - before < 70_000  # 128,000 pairs match
    best = {}
    for qid, i, _, rank in _scored(n, q, 10, search.PLAIN):
        best[qid, rank] = i
    heads = {(r["qid"], r["fts_rank"]): r["id"] for r in got if r["fts_rank"] is not None}
    assert {k: best[k] for k in heads} == heads and {(f"q{i:03d}", 0) for i in range(400)} <= set(heads)


def test_search_response(spark):
    n = nodes(spark, [{"id": x, "title": "fox", "is_active": True, "embedding": [1.0, 0.0]} for x in "abc"])
    q = spark.createDataFrame([("q1", "fox", None), ("q2", "zzz", None)], "qid string, text string, embedding array<float>")
    out = {r["qid"]: r for r in hybrid.search_response(n, q, 2, edges(spark)).collect()}
    assert [x["id"] for x in out["q1"]["nodes"]] == ["a", "b"] and out["q1"]["total"] == 2 and out["q2"]["nodes"] == [] and out["q2"]["total"] == 0
    assert out["q1"]["nodes"][1]["evidence_chain"] == ["a", "c", "d"]
    for bad in (0, 21):
        with pytest.raises(ValueError):
            hybrid.search_response(n, q, bad)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://host", staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        session.shared_folder(type("S", (), {"sparkContext": Context})())


def test_scratch_removes_its_tables(spark):
    with session.scratch():
        kept = session.cut(spark.range(3))
        with session.scratch():
            inner = session.cut(spark.range(4))
            store = session.store_folder(spark)
            inner.write.parquet(store)
            paths = [inner.inputFiles()[0].rsplit("/", 1)[0], store]
            assert all(storage.exists(spark, p) for p in paths)
        assert not any(storage.exists(spark, p) for p in paths) and kept.count() == 3


def test_vector_search_skips_unusable_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("f", [float("nan"), 1.0]), ("c", [2.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None)], "qid string, embedding array<float>")
    out = vectors.search(v, q, 5).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in out] == [("a", 1.0), ("c", 1.0), ("b", 0.707107)]
    assert [r["id"] for r in vectors.search_one(v, [1.0, 0.0], 2).collect()] == ["a", "c"]
    assert vectors.search(v, q.limit(0)).count() == 0
    many = spark.createDataFrame([(f"q{i}", [1.0, float(i)]) for i in range(7)], "qid string, embedding array<float>")
    assert vectors.search(v, many, 1, block=3).count() == 7
    rng = np.random.default_rng(1)
    more = spark.createDataFrame([(f"v{i}", [float(x) for x in rng.standard_normal(2)]) for i in range(60)], "id string, embedding array<float>").unionByName(v)
    asked = many.unionByName(q)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(vectors.search(more, asked, 4)) == rows(vectors.search(more, asked, 4, block=2, piece=7))
    clash = more.withColumns({"qid": F.lit("x"), "block": F.lit(1), "rank": F.lit(9)})
    assert rows(vectors.search(clash, asked.withColumn("id", F.lit("y")), 4, block=2, piece=7)) == rows(vectors.search(more, asked, 4))


def test_hybrid_with_evidence(spark):
    n = nodes(spark, [{"id": x, "title": t, "is_active": True, "embedding": e} for x, t, e in [("a", "fox", [1.0, 0.0]), ("b", "dog", [0.0, 1.0]), ("d", "cat", None)]])
    q = spark.createDataFrame([("q1", "fox", [0.0, 1.0]), ("q2", "zzz", [0.0, 1.0])], "qid string, text string, embedding array<float>")
    out = {(r["qid"], r["id"]): r for r in hybrid.with_evidence(hybrid.hybrid(n, q, Parameters(gate=0.01)), edges(spark), 2).collect()}
    assert set(out) == {("q1", "a"), ("q2", "a"), ("q2", "b")}
    assert out[("q2", "b")]["evidence_chain"] == ["a", "d"] and out[("q2", "b")]["related_nodes"] == ["d"] and out[("q1", "a")]["related_nodes"] == []


def _records(spark, rows):
    return spark.createDataFrame(rows, RECORDS)


@pytest.mark.parametrize("days,want", [(-1, 1.0), (0, 1.0), (1, 1.0), (4, 0.75), (7, 0.5), (18.5, 0.3), (30, 0.1), (31, 0.1)])
def test_recency(spark, days, want):
    t = (NOW - dt.timedelta(days=days)).isoformat()
    assert _records(spark, [("s", t, "", "", 1)]).select(scoring.recency(F.col("ts"), ts(NOW))).first()[0] == pytest.approx(want)


def test_recency_of_bad_times(spark):
    r = _records(spark, [("s", x, "", "", 1) for x in (None, "", "soon", "2024-01-01T00:00:00+02:00")])
    assert {x[0] for x in r.select(scoring.recency(F.col("ts"), ts(NOW))).collect()} == {0.5}


def test_clarity_and_frequency(spark):
    lengths = {0: 0, 99: 0.99, 100: 1, 1000: 1, 1001: 0.999889, 5500: 0.5, 9000: 0.5}
    r = _records(spark, [("s", None, "x" * n, None, None) for n in lengths])
    got = {x[0]: x[1] for x in r.select(F.length("content"), F.round(scoring.clarity(F.col("content")), 6)).collect()}
    assert got == pytest.approx(lengths)
    counts = {None: 0.1, 1: 0.1, 10: 1.0, 25: 1.0, 0: 0.0}
    r = _records(spark, [("s", None, None, None, n) for n in counts])
    assert {x[0]: x[1] for x in r.select("access_count", scoring.frequency(F.col("access_count"))).collect()} == pytest.approx(counts)


def test_whole_score_and_substring_traps(spark):
    text = "We decided the next step: the task goal must be done"
    r = _records(spark, [("s1", NOW.isoformat(), text, None, None)])
    done = consolidate.scored(r, ts(NOW))
    assert done.first()["score"] == 0.570857
    assert [tuple(consolidate.counters(done, t).first()) for t in (0.3, 0.5, 0.7)] == [(1, 1, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0)]
    trap = _records(spark, [("s", None, "a ta", "sk b", 1), ("s", None, "willow", None, 1)])
    out = trap.select(F.round(scoring.relevance(F.col("content"), F.col("summary")), 3), F.round(scoring.actionability(F.col("content")), 3)).collect()
    assert out[0][0] == 0.2 and out[1][1] == 0.143


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=40), st.integers(-5, 50)), min_size=1, max_size=30))
def test_scores_stay_between_0_and_1(spark, items):
    r = _records(spark, [("s", NOW.isoformat(), t, t, n) for t, n in items])
    assert all(0 <= x["score"] <= 1 for x in consolidate.scored(r, ts(NOW)).collect())


def test_promotion_joins_records_of_one_time(spark):
    text = "task goal result decision conclusion should must will decided action next step todo " + "x" * 60
    r = _records(spark, [("s1", NOW.isoformat(), text, "t" * 150, 10), ("s1", NOW.isoformat(), text + "y", None, 10), ("s2", None, "", None, 1)])
    n = nodes(spark, [{"id": "mem_s1_" + NOW.isoformat(), "version": 4, "is_active": False, "title": "old"}])
    out, counts = consolidate.consolidate(n, r, ts(NOW))
    assert tuple(counts.first()) == (2, 2, 1, 2)
    row = out.first()
    assert out.count() == 1 and row["version"] == 4 and row["is_active"] is False and row["source"] == "sleep_consolidation" and json.loads(row["full_content"])["session_id"] == "s1"


def test_upsert_keeps_unlisted_and_overwrites_listed_nulls(spark):
    cur = nodes(spark, [{"id": "a", "title": "t1", "embedding": [1.0], "is_active": False, "version": 3}])
    upd = spark.createDataFrame([("a", None), ("z", "new"), (None, "lost")], "id string, title string")
    out = {r["id"]: r for r in merge.upsert(cur, upd, ["id"]).collect()}
    assert set(out) == {"a", "z"}
    assert out["a"]["title"] is None and out["a"]["embedding"] == [1.0] and out["a"]["is_active"] is False and out["a"]["version"] == 3
    assert out["z"]["embedding"] is None and out["z"]["is_active"] is True and out["z"]["version"] == 1
    again = merge.upsert(merge.upsert(cur, upd, ["id"]), upd, ["id"])
    assert sorted(map(str, again.collect())) == sorted(map(str, merge.upsert(cur, upd, ["id"]).collect()))


def test_versioned_writes(spark, got):
    w = spark.createDataFrame([("x", None, 1), ("x", 1, 2), ("x", 1, 3), ("x", 2, 4), ("y", 7, 1), (None, None, 1), ("k", 5, 1), ("k", 4, 2)], "id string, expected_version int, patch_ts int")
    base = spark.createDataFrame([("k", 5)], "id string, version int")
    out = merge.versioned_writes(w, base)
    assert got(out, "id", "seq", "applied", "version") == [("k", 1, True, 6), ("k", 2, False, 6), ("x", 1, True, 1), ("x", 2, True, 2), ("x", 3, False, 2), ("x", 4, True, 3), ("y", 1, True, 1)]
    assert got(merge.conflicts(out)) == [("k", 2, 4, 6), ("x", 3, 1, 2)]
    assert merge.versioned_writes(w.limit(0)).count() == 0


def test_write_nodes(spark, got):
    n = nodes(spark, [{"id": "x", "version": 1, "title": "old", "is_active": False, "embedding": [1.0], "created_at": NOW}, {"id": "k", "version": 5, "title": "kept", "is_active": True}])
    day = lambda i: NOW + dt.timedelta(days=i)
    w = spark.createDataFrame(
        [("x", None, day(1), "a"), ("x", 2, day(2), None), ("x", 2, day(3), "no"), ("y", 7, day(1), "new"), ("y", None, day(2), "newer"), ("k", 4, day(1), "refused"), (None, None, day(1), "lost")],
        "id string, expected_version int, patch_ts timestamp_ntz, title string")
    out, patches, refused = merge.write_nodes(n, w)
    assert got(out, "id", "version", "title", "is_active", "created_at", "updated_at", "embedding") == [
        ("k", 5, "kept", True, None, None, None), ("x", 3, None, False, NOW, day(2), [1.0]), ("y", 2, "newer", True, day(1), day(2), None)]
    assert got(patches, "id", "seq", "version", "title") == [("x", 1, 2, "a"), ("x", 2, 3, None), ("y", 1, 1, "new"), ("y", 2, 2, "newer")]
    assert got(refused) == [("k", 1, 4, 5), ("x", 3, 2, 3)]
    out, patches, refused = merge.write_nodes(n, w.limit(0))
    assert out.count() == 2 and patches.count() == refused.count() == 0
    extra = w.withColumns({c: F.lit("clash") for c in ("seq", "version", "applied", "actual_version", "updated_at")})
    assert got(merge.write_nodes(n, extra)[0], "id", "version", "updated_at") == got(merge.write_nodes(n, w)[0], "id", "version", "updated_at")


def test_soft_delete_edges_embeddings(spark, got):
    n = nodes(spark, [{"id": "a", "is_active": True, "version": 1}, {"id": "b", "is_active": True, "version": 1}])
    gone = spark.createDataFrame([("a",), ("q",), ("a",), (None,)], "id string")
    assert got(merge.soft_delete(n, gone, ts(NOW)), "id", "is_active", "updated_at") == [("a", False, NOW), ("b", True, None)]
    assert got(merge.deleted_flags(n, gone)) == [("a", True), ("q", False)]
    v = spark.createDataFrame([("b", [2.0]), ("q", [1.0])], "id string, embedding array<float>")
    assert got(merge.update_embeddings(n, v), "id", "embedding", "version") == [("a", None, 1), ("b", [2.0], 1)]
    e = edges(spark).filter("source_id is not null").withColumn("valid_from", ts(NOW))
    new = spark.createDataFrame([("a", "b", "DERIVED_FROM", "{}"), ("p", "q", "R", None)], "source_id string, target_id string, rel_type string, properties string")
    out = merge.add_edges(e, new)
    assert out.count() == 6 and out.filter("source_id = 'a'").first()["valid_from"] == NOW


def test_current_takes_the_highest_version(spark, got):
    n = nodes(spark, [{"id": "a", "version": 1, "title": "x"}, {"id": "a", "version": 2, "title": None}, {"id": "a", "version": 2, "title": None}, {"id": None, "version": 1}])
    assert got(merge.current(n, "id", "version", "title")) == [("a", 2, None)]


def test_patches_and_snapshots(spark, tmp_path, got):
    d = str(tmp_path)
    rows = spark.createDataFrame([("a", "T", "L", "t", "s", "f", 0.5, "src", None), ("b", "T", "L", None, "s", "f", 0.5, "src", 2)], PATCH["node"].dataType)
    storage.create_patches(rows, f"{d}/log", ts(NOW))
    (tmp_path / "log" / "bad.json").write_text("{nope")
    p = storage.read_patches(spark, f"{d}/log")
    assert storage.count_valid(p).first()[0] == 2 and got(p.filter("not broken"), "node.id", "ts") == [("a", "2024-02-01T00:00:00"), ("b", "2024-02-01T00:00:00")]
    (tmp_path / "p").mkdir()
    for name in ("2024-01-01T00:00:00.000001_patch.json", "2024-02-01T00:00:00_patch.json", "broken_patch.json"):
        (tmp_path / "p" / name).write_text('{\n "node": {"id": "x"},\n "ts": "t"}')
    storage.create_patches(rows.withColumn("at", F.when(F.col("id") == "a", ts("2024-01-15 00:00:00")).otherwise(ts("2024-02-20 00:00:00.5"))), f"{d}/p", F.col("at"))
    log = f"{d}/p"
    want = ["2024-01-01T00:00:00.000001", "2024-01-15T00:00:00", "2024-02-01T00:00:00", "2024-02-20T00:00:00.500000", "broken"]
    assert [r[0] for r in storage.list_patches(spark, log).collect()] == [f"{x}_patch.json" for x in want]
    assert storage.list_patches(spark, log, ts(NOW)).count() == 2
    assert got(storage.read_patches(spark, log), "patch_file", "node.id")[0] == (f"{want[0]}_patch.json", "x")
    assert got(storage.read_patches(spark, log).filter("not broken"), "node.id") == [("a",), ("b",), ("x",), ("x",), ("x",)]
    assert storage.cleanup_patches(spark, log, ts(NOW)) == 2 and storage.list_patches(spark, log).count() == 3
    assert storage.cleanup_patches(spark, log, ts("2024-02-20 00:00:00.5")) == 1 and got(storage.read_patches(spark, log), "patch_file") == [(f"{want[3]}_patch.json",), ("broken_patch.json",)]
    assert storage.cleanup_patches(spark, f"{d}/none", ts(NOW)) == 0 and storage.read_patches(spark, f"{d}/none").count() == 0
    state = spark.createDataFrame([("b", 1, "old")], "id string, version int, title string")
    node = storage.read_patches(spark, log).filter("ts is not null and patch_ts is not null").select("patch_ts", "node.id", "node.title")
    assert got(merge.replay(state, node)) == [("b", 2, None)]
    n = nodes(spark, [{"id": "a", "is_active": False}])
    s = storage.create_snapshot(n, edges(spark), f"{d}/snap", "20240201_000000")
    assert storage.latest_snapshot(spark, f"{d}/snap") == s and [x.count() for x in storage.read_snapshot(spark, f"{d}/snap")] == [1, 6]
    with pytest.raises(Exception):
        storage.create_snapshot(n, edges(spark), f"{d}/snap", s)
    assert tuple(storage.snapshot_counts(n, edges(spark)).first()) == (1, 6)
    assert storage.latest_snapshot(spark, f"{d}/none") is None


def test_replay(spark, got):
    snap = nodes(spark, [{"id": "a", "version": 3, "title": "old", "is_active": True, "full_content": "keep"}])
    p = spark.createDataFrame([("a", NOW, "new"), ("a", NOW + dt.timedelta(1), None), ("b", NOW, "b"), ("a", dt.datetime(2020, 1, 1), "early")], "id string, patch_ts timestamp_ntz, title string")
    out = merge.replay(snap, p, ts(NOW - dt.timedelta(1)))
    assert got(out, "id", "version", "title", "full_content") == [("a", 5, None, "keep"), ("b", 1, "b", None)]


def test_sessions(spark, tmp_path, got):
    d = f"{tmp_path}/s"
    odd = ["s1", "2024:01", "a/b", "k=v", "x/..", "..", "%2e", "", "s 2"]
    r = _records(spark, [("s1", "will be stamped", "x", None, 1), *[(i, None, i, None, None) for i in odd[1:]], (None, None, "nobody's", None, 1)])
    storage.append_records(r, d, ts(NOW))
    storage.append_records(r.limit(0), d, ts(NOW))
    assert got(storage.read_sessions(spark, d, "s1"), "session_id", "ts", "content") == [("s1", "2024-02-01T00:00:00", "x")]
    assert got(storage.list_sessions(storage.read_sessions(spark, d))) == sorted(((i,) for i in odd), key=repr)
    for i in odd[1:]:
        assert got(storage.read_sessions(spark, d, i), "session_id", "content") == [(i, i)]
    for k, i in enumerate(["x/..", "..", "s1", "a/b"]):
        assert storage.delete_session(spark, d, i) and not storage.delete_session(spark, d, i)
        assert storage.read_sessions(spark, d, i).count() == 0 and storage.read_sessions(spark, d).count() == len(odd) - k
    assert not storage.delete_session(spark, d, "../s") and not storage.delete_session(spark, f"{d}/none", "x")
    storage.append_records(r.limit(1), d, ts(NOW))
    assert storage.read_sessions(spark, d, "s1").count() == 1 and storage.read_sessions(spark, d).filter("session_id is null").count() == 1


def test_bucket_keeps_unknown_fields(spark, tmp_path):
    d = f"{tmp_path}/s"
    r = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "session_id string, content string, extra int")
    storage.append_records(r, d, ts(NOW))
    before = [x for x in spark.read.json(d).collect() if x["session_id"] == "b"]
    assert storage.delete_session(spark, d, "a") and [tuple(x) for x in spark.read.json(d).collect()] == [tuple(x) for x in before]


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    text = "task goal result decision conclusion should must will decided action next step todo " + "x" * 60
    (src / "a.json").write_text("\n".join(json.dumps({"session_id": "s", "ts": f"2024-01-31T0{i}:00:00", "content": text, "access_count": 10}) for i in range(3)))
    q = consolidation.consolidate_stream(storage.session_stream(spark, str(src)), str(out), f"{tmp_path}/cp", NOW)
    q.awaitTermination(60)
    assert spark.read.parquet(f"{out}/batch=*").count() == 3
    assert consolidation.session_activity(storage.session_stream(spark, str(src))).isStreaming


MD = "---\nid: {}\ntype: L1\nparents:[]\n---\n# {}\n\nBody\n"


def test_markdown(spark, tmp_path, got):
    for layer, name, text in [("L0_Axioms", "x", MD.format("n1", "能量守恒")), ("L2_Engineering", "y", MD.format("n1", "Later")), ("L1_Theorems", "z", "no header"), ("L1_Theorems", "w", "---\nid: q\n no end"), ("L1_Theorems", "v", "---\ntype: a\n---\n# t"), ("L1_Theorems", "u", "---\r\nid: crlf\r\n---\r\n# Title\r\n")]:
        (tmp_path / layer).mkdir(exist_ok=True)
        (tmp_path / layer / f"{name}.md").write_bytes(text.encode())
    f = storage.node_files(spark, str(tmp_path))
    assert got(documents.node_index(f), "id", "title") == [("crlf", "Title"), ("n1", "Later")]
    assert got(documents.index_lines(documents.node_index(f)), "line") == [("- [crlf]: Title",), ("- [n1]: Later",)]
    n, counts = storage.sync(spark, empty(spark, NODES), [{"type": "local_markdown", "path": str(tmp_path)}, {"type": "github_wiki", "path": str(tmp_path / "L0_Axioms"), "target_layer": "L0"}, {"type": "other", "path": "x"}, {"type": "github_wiki", "path": "/nowhere"}])
    assert got(counts) == [("github_wiki", 1), ("local_import", 6)] and n.count() == 6
    assert storage.node_files(spark, f"{tmp_path}/nothing").count() == 0


def test_markdown_written(spark, tmp_path, got):
    n = spark.createDataFrame([("a 1", "L2_Engineering", "p", "T", "b"), ("a1", "L2_Engineering", None, "U", "b"), ("c", None, None, "V", None), ("!", "L1", None, "W", "b")], "id string, layer string, parents string, title string, body string")
    messages = storage.write_nodes_markdown(n, str(tmp_path))
    assert got(messages, "id") == [("",), ("a1",), ("a1",), ("c",)]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.md")) == ["L1_Theorems/c.md", "L2_Engineering/a1.md"]
    assert got(storage.node_files(spark, str(tmp_path)), "id", "title", "layer") == [("a1", "T", "L2_Engineering"), ("c", "V", "L1_Theorems")]
    storage.write_nodes_markdown(n.limit(0), f"{tmp_path}/none")
    assert storage.open_store(spark, f"{tmp_path}/none")[0].columns == NODES.fieldNames()


def test_fetch_and_render(spark):
    f = spark.createDataFrame([("a", "x" * 1500), ("b", "x" * 1501)], "id string, content string")
    out = {r["id"]: r["content"] for r in documents.fetch(f, spark.createDataFrame([(" a!",), ("b",), ("zz",)], "id string")).collect()}
    assert out["a"] == "x" * 1500 and out["b"] == "x" * 1500 + "\n...[已截断]" and out["zz"] == "[DAG Error] 未找到节点: zz。"
    n = spark.createDataFrame([(" a-b_c 1! ", "L2_Engineering", "p 1,, ,q", " T ", " body "), ("能量", None, None, "t", "b")], "id string, layer string, parents string, title string, body string")
    a, b = documents.rendered(n).orderBy(F.desc("id")).collect()
    assert a["content"] == "---\nid: ab_c1\ntype: L2_Engineering\nparents: [p1,q]\n---\n# T\n\nbody\n" and a["directory"] == "L2_Engineering"
    assert b["content"] is None and "非法" in b["message"]


def test_actions(spark):
    text = "x</think>[ACTION: FETCH('n1')] [action: fetch(n2)] [ACTION: TENTACLE( why? )] [ACTION: WRITE_NODE(a ;; T ;; p1,p2 ;; body ;; more)] [ACTION: WRITE_NODE(a;;b;;c)] [ACTION: FINISH([\"t1\",\"t2\"])]"
    r = spark.createDataFrame([(text,)], "t string").select(
        markup.without_reasoning(F.col("t")).alias("a"), markup.fetches(F.col("t")).alias("f"), markup.queries_asked(F.col("t")).alias("q"), markup.writes(F.col("t")).alias("w"), markup.finished(F.col("t")).alias("d")).first()
    assert r["a"].startswith("[ACTION: FETCH") and r["f"] == ["n1", "n2"] and r["q"] == ["why?"]
    assert [tuple(w) for w in r["w"]] == [("a", "T", "p1,p2", "body ;; more")] and r["d"] == ["t1", "t2"]
    e = spark.createDataFrame([("[ACTION: FINISH(so: [\"x\"] then)]",), ("[ACTION: FINISH([])]",), ("[ACTION: FINISH(none)]",), ("",), (None,)], "t string")
    assert [x[0] for x in e.select(markup.finished(F.col("t"))).collect()] == [["x"], None, None, None, None]
    assert spark.range(1).select(markup.external_id(F.lit("a b/c 0123456789xyz"), F.lit(5)), markup.blueprint_id(F.lit(7))).first()[:] == ("ext_a_b_c_012345678_5", "bp_7")


def test_tasks(spark):
    t = spark.createDataFrame([(1, "# title\n- [x][id:00000001] done\n- [ ][id:0000000a] first\n- [ ] second\n"), (2, "nothing"), (3, None)], "doc_id int, text string")
    tasks, rest = documents.pop_tasks(t)
    assert [tuple(x) for x in tasks.collect()] == [(1, "0000000a", "first")]
    tasks2, rest2 = documents.pop_tasks(rest)
    assert [tuple(x) for x in tasks2.collect()] == [(1, "unknown", "second")]
    assert documents.pop_tasks(rest2)[0].count() == 0 and rest2.filter("doc_id = 3").first()["text"] is None
    assert documents.task_lines(t).count() == 3
    added = spark.range(1).select(documents.append_tasks(F.lit("list"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("i1"), F.lit("i2")))).first()[0]
    assert added == "list\n- [ ][id:i1] a\n- [ ][id:i2] b\n"
    assert len(spark.range(1).select(documents.append_tasks(F.lit(""), F.array(F.lit("a")))).first()[0]) == len("\n- [ ][id:12345678] a\n")
    c = spark.range(1).select(documents.capsules(F.array(F.lit("t")), F.array(F.lit("/p"))), documents.capsules(F.array(F.lit("t")), F.array().cast("array<string>"))).first()
    assert c[0][0].endswith("  - /p") and c[1] == ["t"]
    assert spark.range(1).select(documents.report_entry(F.lit("1"), F.lit("ok"), F.lit("d"))).first()[0] == "【任务汇报 - ID:1 | 状态:ok】:\nd"


def test_messages(spark, got):
    m = spark.createDataFrame([("a", i, "x" if i in (3, 4) else str(i)) for i in range(1, 10)] + [("b", 1, "y"), (None, 1, "z")], "s string, n int, t string")
    assert got(documents.message_window(m, ["s"], ["n"]), "s", "n", "pos") == [("a", 1, 1), ("a", 6, 6), ("a", 7, 7), ("a", 8, 8), ("a", 9, 9), ("b", 1, 1)]
    assert got(documents.repeats(m, ["s"], ["n"], "t").filter("repeated"), "s", "n") == [("a", 4)]
    lines = ['data: {"choices":[{"delta":{"content":"He"}}]}', "noise", "data: {bad", 'data: {"choices":[{"delta":{"content":"y"}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"no"}}]}']
    s = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "key string, n int, line string")
    assert got(documents.stream_text(s, "key", "n")) == [("k", "Hey")]


def test_people_personas_memory(spark, tmp_path, got):
    e = spark.createDataFrame([("Ann Lee", ["AL"]), ("Bob", None)], "name string, aliases array<string>")
    assert [r["name"] for r in documents.people(e, "al").collect()] == ["Ann Lee"]
    (tmp_path / "p.json").write_text('{"system_prompt": "hi", "params": {"temperature": 0.5}, "x": 1}')
    (tmp_path / "bad.json").write_text("{")
    assert storage.read_persona(spark, f"{tmp_path}/p.json") == {"system_prompt": "hi", "params": {"temperature": 0.5}}
    assert storage.read_persona(spark, f"{tmp_path}/bad.json") == storage.read_persona(spark, f"{tmp_path}/no.json") == {"system_prompt": "", "params": {}}
    assert storage.read_memory(spark, str(tmp_path), "todo").startswith("# ") and storage.read_memory(spark, str(tmp_path), "other") == ""
    storage.write_memory(spark, str(tmp_path), "todo", "one")
    storage.write_memory(spark, str(tmp_path), "todo", "two", append=True)
    assert storage.read_memory(spark, str(tmp_path), "todo") == "onetwo\n"
    g = spark.createDataFrame([("a", '{"id":"a","n":{"x":1,"y":[1]}}', "old"), ("b", '{"id":"b","n":1}', "old"), ("c", "broken", "old"), ("d", None, "old")], "id string, entity string, updated string")
    out = {r["id"]: r for r in storage.update_entity(g, "a", {"n": {"y": [2], "z": {"q": None}}, "name": "新"}, F.lit("2024-02-01")).collect()}
    assert json.loads(out["a"]["entity"]) == {"id": "a", "n": {"x": 1, "y": [2], "z": {"q": None}}, "name": "新"} and {r["updated"] for r in out.values()} == {"2024-02-01"}
    assert out["b"]["entity"] == '{"id":"b","n":1}' and out["c"]["entity"] == "broken" and out["d"]["entity"] is None
    changes = spark.createDataFrame([("a", "[1]"), ("b", '{"n":{"k":1}}'), ("c", "{}"), ("zz", "{}")], "id string, change string")
    assert [r["entity"] for r in storage.update_entities(g, changes).orderBy("id").collect()] == ['{"id":"a","n":{"x":1,"y":[1]}}', '{"id": "b", "n": {"k": 1}}', "broken", None]
    p = spark.createDataFrame([(1, '{"system_prompt":"x","params":{"t":1}}'), (2, "[1]"), (3, "{} more"), (4, None), (5, '{"params":{}}')], "doc_id int, text string")
    assert got(documents.personas(p)) == [(1, "x", '{"t":1}'), (2, "", "{}"), (3, "", "{}"), (4, "", "{}"), (5, "", "{}")]


def test_ids_times_embeddings(spark):
    r = spark.createDataFrame([(" a-b_c 1! ", "['x', , \"y z\"]", '{"b":1, "a":2}'), ("能量", None, "oops"), (None, "-", None)], "i string, p string, j string")
    out = r.select(ids.clean_id(F.col("i")), ids.sanitize_id(F.col("i")), ids.parent_ids(F.col("p")), ids.canonical_json(F.col("j"))).collect()
    assert [tuple(x) for x in out] == [("ab_c1", "ab_c1", ["x", "yz"], '{"a":2,"b":1}'), (None, "", [], "raw:oops"), (None, None, [], None)]
    t = spark.range(1).select(times.iso(ts(NOW)), times.iso(ts("2024-01-01 00:00:00.5")), times.snapshot_id(ts(NOW))).first()
    assert tuple(t) == ("2024-02-01T00:00:00", "2024-01-01T00:00:00.500000", "20240201_000000")
    v = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(embedding.embed(F.col("t"), lambda: embedding.hashing_encoder(8)).alias("embedding"))
    rows = v.collect()
    assert np.linalg.norm(rows[0][0]) == pytest.approx(1) and rows[1][0] is None and sum(rows[2][0]) == 0
    assert embedding.dimension(v).first()[0] == 8
