"""Queries of the knowledge store: lookups, links, search, scoring, consolidation, writes and document parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import embedding, ids, markup, scoring, times
from grainmill.operators import consolidate, documents, graph, hybrid, merge, search, vectors
from grainmill.schema import Parameters
from grainmill.session import cut, store_folder, table
from grainmill.sources import storage

AS_OF = "2025-06-30 00:00:00"
NOW = "2026-01-01 00:00:00"
SINCE = "2025-01-01 00:00:00"
#: Texts asked for, with the vec_id of the vector that goes with each.
ASKED = [("q_law", "law of", 0), ("q_note", "note principle", 1), ("q_none", "zzzz", 2), ("q_open", "open question need", 3), ("q_silent", "silent", 4)]
WIDE_GATE = Parameters(gate=2.0)
#: The score from which records are promoted.
PROMOTE = 0.8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _now(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return merge.current(table(spark, d, "nodes"), *columns)


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _asked(spark: SparkSession, d: str, nodes: DataFrame) -> DataFrame:
    """Queries (qid, text, embedding): the title and vector of every node whose number is divisible by 20, and the fixed texts."""
    fixed = spark.createDataFrame(ASKED, "qid string, text string, vec_id long").join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("long")
    return fixed.select("qid", "text", "embedding").unionByName(nodes.filter(number % 20 == 0).select(F.col("id").alias("qid"), F.col("title").alias("text"), "embedding"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Session records made of the documents."""
    return table(spark, d, "documents").select(
        "doc_id", "session_id", times.iso(F.col("created_at")).alias("ts"), F.col("text").alias("content"), F.col("source").alias("summary"), (F.col("n_chars") % 15).alias("access_count"))


def _filled(df: DataFrame, *columns: str) -> DataFrame:
    """-1 for a missing rank or version, so that whole numbers stay whole numbers in any client."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in columns})


# Lookups


@query
def nodes_summary_lookup(spark, d):
    return documents.get_nodes(_now(spark, d, "id", "type", "layer", "title", "summary", "confidence", "source", "version", "created_at", "updated_at", "is_active")).withColumn("confidence", F.col("confidence").cast("double"))


@query
def nodes_full_lookup(spark, d):
    wanted = table(spark, d, "edges").filter("rel_type = 'CONTRADICTS'").select(ids.clean_id(F.col("target_id")).alias("id")).filter("id is not null")
    cols = ("id", "type", "title", "summary", "full_content", "version", "is_active")
    return documents.get_nodes(_now(spark, d, *cols), wanted, "full")


@query
def edges_filter(spark, d):
    return graph.edges_where(table(spark, d, "edges"), target_id="", rel_type="CONTRADICTS")


@query
def related_nodes(spark, d):
    return graph.related(table(spark, d, "edges"))


@query
def trace_depth1(spark, d):
    return graph.trace(table(spark, d, "edges"), 1)


@query
def trace_depth2(spark, d):
    return graph.trace(table(spark, d, "edges"), 2)


@query
def trace_depth3(spark, d):
    return graph.trace(table(spark, d, "edges"), 3)


@query
def trace_cyclic(spark, d):
    """A bounded trace: the nodes on a cycle of at most six links; p2_found finds cycles of any length."""
    return graph.trace(table(spark, d, "edges"), 6).filter("root = id")


# Search


@query
def bm25_topk(spark, d):
    n = cut(_now(spark, d, "id", "title", "summary", "is_active", "embedding"))
    return search.bm25(n, _asked(spark, d, n), 10)


@query
def bm25_folded(spark, d):
    """Terms without accents and without a few stop words."""
    n = cut(_now(spark, d, "id", "title", "summary", "is_active", "embedding"))
    return search.bm25(n, _asked(spark, d, n), 10, search.Analyser(fold=True, stop_words=("the", "of", "on", "and", "note")))


@query
def bm25_stemmed(spark, d):
    n = cut(_now(spark, d, "id", "title", "summary", "is_active", "embedding"))
    return search.bm25(n, _asked(spark, d, n), 10, search.Analyser(fold=True, stop_words="english", stem=True))


@query
def bm25_postings_stats(spark, d):
    return search.statistics(_now(spark, d, "id", "title", "summary"))


@query
def bm25_corpus(spark, d):
    return search.corpus(_now(spark, d, "id", "title", "summary")).withColumn("avgdl", F.round("avgdl", 6))


@query
def vector_topk(spark, d):
    """The ten nodes most similar to every vector whose id is divisible by 20."""
    asked = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.search(_now(spark, d, "id", "embedding", "is_active").filter("is_active").select("id", "embedding"), asked)


@query
def vector_top1_query(spark, d):
    """One query by built-in expressions alone: nearest vectors to the axis of the first coordinate."""
    return vectors.search_one(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), [1.0] + [0.0] * 63)


@query
def vector_dimension(spark, d):
    return embedding.dimension(_now(spark, d, "id", "embedding"))


@query
def rrf_fusion(spark, d):
    n = cut(_now(spark, d, "id", "title", "summary", "is_active", "embedding"))
    q = cut(_asked(spark, d, n))
    fused = hybrid.fuse(search.bm25(n, q, 10), vectors.search(n.filter("is_active").select("id", "embedding"), q, 10))
    return _filled(fused, "fts_rank", "vec_rank")


def _hybrid(spark, d, p, always=False):
    n = cut(_now(spark, d, "id", "title", "summary", "confidence", "is_active", "embedding"))
    hits = hybrid.hybrid(n, cut(_asked(spark, d, n)), p, always).withColumn("confidence", F.col("confidence").cast("double"))
    return _filled(hits, "fts_rank", "vec_rank")


@query
def hybrid_gated(spark, d):
    return _hybrid(spark, d, Parameters())


@query
def hybrid_wide_gate(spark, d):
    return _hybrid(spark, d, WIDE_GATE)


@query
def hybrid_always(spark, d):
    return _hybrid(spark, d, Parameters(top_k=20), True)


@query
def hybrid_with_evidence(spark, d):
    out = hybrid.with_evidence(cut(_hybrid(spark, d, WIDE_GATE)), table(spark, d, "edges"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("evidence_chain", "related_nodes")})


@query
def search_response(spark, d):
    """One row per query: how many hits, and which, in order; queries without any included."""
    n = cut(_now(spark, d, "id", "title", "summary", "confidence", "is_active", "embedding"))
    out = hybrid.search_response(n, cut(_asked(spark, d, n)), 7)
    return out.select("qid", F.array_join(F.transform("nodes", lambda x: x["id"]), ",").alias("ids"), "total")


# Scoring and consolidation


def _dimension(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return records(spark, d).select("doc_id", F.round(scoring.dimensions(_ts(AS_OF))[name], 6).alias(name))

    return run


for _name in scoring.WEIGHTS:
    QUERIES[f"score_{_name}"] = _dimension(_name)


def _scored(spark, d):
    return consolidate.scored(records(spark, d), _ts(AS_OF))


@query
def memory_score(spark, d):
    return _scored(spark, d).select("doc_id", "score")


@query
def sleep_light_counters(spark, d):
    return consolidate.counters(_scored(spark, d), consolidate.STAGES["light"])


@query
def sleep_rem_counters(spark, d):
    return consolidate.counters(_scored(spark, d), consolidate.STAGES["rem"])


@query
def sleep_deep_counters(spark, d):
    return consolidate.counters(_scored(spark, d), consolidate.STAGES["deep"])


@query
def sleep_promotions(spark, d):
    """Promoted records; full_content is shown by the fields of the record it holds."""
    out = consolidate.promotions(_scored(spark, d), 0.5, PROMOTE)
    fields = {f"record_{k}": F.get_json_object("full_content", f"$.{k}") for k in ("session_id", "ts", "content", "access_count")}
    return out.withColumns(fields).drop("full_content")


@query
def sleep_sessions_counters(spark, d):
    """Counters of sessions that were asked for, two of which don't exist."""
    asked = records(spark, d).select("session_id").dropna().distinct().unionByName(spark.createDataFrame([("no-such-1",), ("no-such-2",)], "session_id string"))
    return consolidate.counters(_scored(spark, d), consolidate.STAGES["rem"], asked)


# Writes


@query
def upsert_nodes(spark, d):
    """Current nodes with the last patch of each id written over them."""
    cur = _now(spark, d, "id", "type", "layer", "title", "summary", "confidence", "source", "version", "is_active")
    p = table(spark, d, "node_patches").filter("patch_ts is not null").select("id", "patch_ts", "patch_file", "type", "layer", "title", "summary", "confidence", "source")
    upd = merge.last_writes(p, ["id"], ["patch_ts", "patch_file"]).drop("patch_ts", "patch_file")
    return merge.upsert(cur, upd, ["id"]).withColumn("confidence", F.col("confidence").cast("double"))


def _writes(spark, d):
    p = table(spark, d, "node_patches").select("id", "patch_ts", "patch_file", "expected_version").distinct()
    return merge.versioned_writes(p, order=["patch_ts", "patch_file", "expected_version"])


@query
def versioned_writes(spark, d):
    return _filled(_writes(spark, d), "expected_version", "actual_version").drop("patch_ts", "patch_file")


@query
def write_conflicts(spark, d):
    return merge.conflicts(_writes(spark, d))


def _written(spark, d):
    """Nodes of the first snapshot after the conditional writes that came later."""
    s = table(spark, d, "node_snapshots")
    first = s.agg(F.min("snapshot_id").alias("snapshot_id"))
    columns = ("id", "type", "layer", "title", "summary", "confidence", "source", "version", "is_active", "created_at", "updated_at")
    nodes = merge.current(s.join(F.broadcast(first), "snapshot_id").filter("id <> ''").select(*columns))  # one row
    p = table(spark, d, "node_patches").crossJoin(F.broadcast(first)).filter(F.col("patch_ts") > F.to_timestamp_ntz("snapshot_id", F.lit("yyyyMMdd_HHmmss")))
    p = p.select("id", "patch_ts", "patch_file", "expected_version", "type", "layer", "title", "summary", "confidence", "source").distinct()
    return merge.write_nodes(nodes, p, ["patch_ts", "patch_file", "expected_version"])


@query
def nodes_written(spark, d):
    out = _written(spark, d)[0].withColumn("confidence", F.col("confidence").cast("double"))
    return out.withColumns({c: times.iso(F.col(c)) for c in ("created_at", "updated_at")})


@query
def patches_accepted(spark, d):
    return _written(spark, d)[1].select("id", "seq", "version", "patch_file", "title")


@query
def writes_refused(spark, d):
    return _written(spark, d)[2]


@query
def soft_delete(spark, d):
    gone = table(spark, d, "edges").filter("rel_type = 'CONTRADICTS'").select(ids.clean_id(F.col("target_id")).alias("id"))
    out = merge.soft_delete(_now(spark, d, "id", "version", "is_active", "updated_at"), gone, _ts(NOW))
    return out.withColumn("updated_at", times.iso(F.col("updated_at")))


@query
def soft_delete_found(spark, d):
    gone = table(spark, d, "edges").filter("rel_type = 'CONTRADICTS'").select(ids.clean_id(F.col("target_id")).alias("id"))
    return merge.deleted_flags(_now(spark, d, "id", "version"), gone)


@query
def edge_upsert(spark, d):
    """Edges of the earliest delivery of each link, with the properties of the last one written over them."""
    keys = ["source_id", "target_id", "rel_type"]
    e = table(spark, d, "edges").dropna(subset=[*keys, "valid_from"])
    first = e.groupBy(*keys).agg(F.min("valid_from").alias("valid_from")).withColumns({"valid_until": F.lit(None).cast("timestamp_ntz"), "properties": F.lit(None).cast("string")})
    last = e.groupBy(*keys).agg(F.max(F.struct("valid_from", F.coalesce("properties", F.lit("")).alias("properties"))).alias("w")).select(*keys, "w.properties")
    return merge.add_edges(first, last).select(*keys, times.iso(F.col("valid_from")).alias("valid_from"), "properties")


@query
def embedding_update(spark, d):
    """Nodes whose version is the number of a vector get that vector; a sum weighted by place shows all coordinates."""
    cur = _now(spark, d, "id", "version", "embedding")
    new = cur.select("id", F.col("version").cast("long").alias("vec_id")).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    out = merge.update_embeddings(cur, new)
    places = F.zip_with("embedding", F.sequence(F.lit(1), F.size("embedding")), lambda x, i: x.cast("double") * i)
    whole = F.when((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.aggregate(places, F.lit(0.0), lambda a, x: a + x))
    return out.select("id", "version", F.size("embedding").alias("size"), F.round(whole, 3).alias("weighted"))


@query
def patch_replay(spark, d):
    """State after the first snapshot and all patches later than it."""
    s = table(spark, d, "node_snapshots")
    first = s.agg(F.min("snapshot_id").alias("snapshot_id"))
    snap = s.join(F.broadcast(first), "snapshot_id").filter("id <> ''").select("id", "type", "layer", "title", "summary", "confidence", "source", "version", "is_active", "updated_at")
    p = table(spark, d, "node_patches").crossJoin(F.broadcast(first))  # one row
    p = p.filter(F.col("patch_ts") > F.to_timestamp_ntz("snapshot_id", F.lit("yyyyMMdd_HHmmss"))).drop("snapshot_id")
    out = merge.replay(merge.current(snap), p)
    return out.withColumns({"confidence": F.col("confidence").cast("double"), "updated_at": times.iso(F.col("updated_at"))})


# Stored forms


@query
def patches_since(spark, d):
    return storage.patches_since(table(spark, d, "node_patches"), _ts(SINCE)).withColumn("patch_ts", times.iso(F.col("patch_ts")))


@query
def patches_to_clean(spark, d):
    return storage.patches_older(table(spark, d, "node_patches"), _ts(SINCE)).select("patch_file")


@query
def snapshot_counts(spark, d):
    return storage.snapshot_counts(table(spark, d, "nodes"), table(spark, d, "edges"))


@query
def snapshot_names(spark, d):
    return table(spark, d, "nodes").select(times.snapshot_id(F.col("updated_at")).alias("name")).distinct()


@query
def sessions_list(spark, d):
    return storage.list_sessions(records(spark, d))


@query
def ingest_counts(spark, d):
    return storage.ingest_counts(table(spark, d, "nodes"))


def _odd_sessions(spark, d):
    """Records whose session ids hold signs that mean something in paths."""
    r = records(spark, d)
    return r.withColumn("session_id", F.concat("session_id", F.lit("/../x:=%"), (F.col("doc_id") % 3).cast("string")))


def _session_store(spark, d) -> str:
    folder = store_folder(spark)
    half = F.col("doc_id") % 2 == 0
    for part in (half, ~half):  # the second write appends
        storage.append_records(_odd_sessions(spark, d).filter(part).drop("doc_id"), folder, _ts(NOW))
    return folder


def _largest_session(spark, d) -> str:
    row = _odd_sessions(spark, d).dropna(subset=["session_id"]).groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    return row["session_id"] if row else ""


@query
def session_store(spark, d):
    r = storage.read_sessions(spark, _session_store(spark, d))
    return r.select("session_id", "ts", F.md5("content").alias("digest"), "summary", F.coalesce("access_count", F.lit(-1)).alias("access_count"))


@query
def session_read(spark, d):
    """Records of the largest session."""
    r = storage.read_sessions(spark, _session_store(spark, d), _largest_session(spark, d))
    return r.select("session_id", F.md5("content").alias("digest"))


@query
def session_delete(spark, d):
    """Records per session once the largest session is deleted; deleting it again finds nothing."""
    folder, largest = _session_store(spark, d), _largest_session(spark, d)
    found = [storage.delete_session(spark, folder, x) for x in (largest, largest, "x/..", "..")]
    return storage.read_sessions(spark, folder).groupBy("session_id").agg(F.count("*").alias("n")).withColumn("found", F.lit(",".join(map(str, found)).lower()))


def _patch_log(spark, d) -> str:
    folder = store_folder(spark)
    p = table(spark, d, "node_patches").filter("patch_ts is not null").select("id", "type", "layer", "title", "summary", "confidence", "source", "expected_version", "patch_ts")
    storage.create_patches(p, folder, F.col("patch_ts"))
    return folder


@query
def patch_log_list(spark, d):
    return storage.list_patches(spark, _patch_log(spark, d), _ts(SINCE)).withColumn("patch_ts", times.iso(F.col("patch_ts")))


@query
def patch_log_read(spark, d):
    p = storage.read_patches(spark, _patch_log(spark, d))
    fields = ["id", "type", "layer", "title", "summary", "source"]
    return p.select("patch_file", *[F.col(f"node.{c}").alias(c) for c in fields], F.round("node.confidence", 4).alias("confidence"), F.coalesce("node.expected_version", F.lit(-1)).alias("expected_version"))


@query
def patch_log_valid(spark, d):
    return storage.count_valid(storage.read_patches(spark, _patch_log(spark, d)))


@query
def patch_log_cleaned(spark, d):
    """What the log still holds after those older than a time are deleted, and how many these were."""
    folder = _patch_log(spark, d)
    n = storage.cleanup_patches(spark, folder, _ts(SINCE))
    left = storage.read_patches(spark, folder).groupBy("patch_file").agg(F.count("*").alias("n"))
    return left.withColumn("n_deleted", F.lit(n).cast("long"))


@query
def snapshot_store(spark, d):
    """Both tables as they come back from a snapshot that was opened by its pointer."""
    folder = store_folder(spark)
    empty_nodes, _ = storage.open_store(spark, folder)
    storage.create_snapshot(empty_nodes, table(spark, d, "edges").limit(0), folder, "20250101_000000")
    storage.create_snapshot(table(spark, d, "nodes"), table(spark, d, "edges"), folder, "20250102_000000")
    nodes, edges = storage.open_store(spark, folder)
    return nodes.select(F.lit("node").alias("kind"), "id", F.md5("full_content").alias("digest")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("source_id").alias("id"), F.md5(F.concat_ws("|", "target_id", "rel_type", "properties")).alias("digest")))


# Documents


def _markdown(spark, d) -> str:
    """A folder with the front-matter nodes as files, and one with the axioms as pages of a wiki."""
    folder = store_folder(spark)
    n = table(spark, d, "dag_nodes").select("id", F.split("path", "/")[1].alias("layer"), "parents", "title", "body")
    storage.write_nodes_markdown(n, f"{folder}/dag")
    page = F.concat(F.lit("---\ntitle: "), "title", F.lit("\nsummary: of "), "id", F.lit("\n---\n\n"), F.col("body"), F.lit("\n\n"))
    storage.write_texts(table(spark, d, "axioms").select(F.lit("wiki").alias("directory"), F.concat("id", F.lit(".md")).alias("name"), page.alias("content")), folder)
    return folder


@query
def markdown_files(spark, d):
    """Nodes as they are parsed back from the files they were written to."""
    files = storage.node_files(spark, f"{_markdown(spark, d)}/dag")
    return files.select("id", "type", "parents", "title", F.md5("content").alias("digest"), "layer")


def _synced(spark, d):
    folder = _markdown(spark, d)
    sources = [
        {"type": "local_markdown", "path": f"{folder}/dag"}, {"type": "github_wiki", "path": f"{folder}/wiki", "target_layer": "L0"},
        {"type": "other", "path": folder}, {"type": "github_wiki", "path": f"{folder}/none"}]
    cur = _now(spark, d, "id", "type", "layer", "title", "summary", "full_content", "confidence", "source", "version", "is_active")
    return storage.sync(spark, cur, sources)


@query
def markdown_import(spark, d):
    out = _synced(spark, d)[0]
    return out.select("id", "type", "layer", "title", "summary", F.md5("full_content").alias("digest"), F.col("confidence").cast("double").alias("confidence"), "source", "version", "is_active")


@query
def markdown_import_counts(spark, d):
    return _synced(spark, d)[1]


@query
def memory_files(spark, d):
    """Memory files after a write and an append; what was never written has its first content."""
    folder = store_folder(spark)
    text = table(spark, d, "axioms").agg(F.min("title")).first()[0] or ""
    storage.write_memory(spark, folder, "todo", "first\n")
    storage.write_memory(spark, folder, "todo", text, append=True)
    storage.write_memory(spark, folder, "no such kind", text)
    kinds = [*storage.MEMORY_FILES, "no such kind"]
    return spark.createDataFrame([(k, storage.read_memory(spark, folder, k)) for k in kinds], "kind string, content string")


@query
def personas(spark, d):
    return documents.personas(table(spark, d, "documents").filter("source = 'persona'"))


@query
def persona_file(spark, d):
    folder = store_folder(spark)
    files = [("p", "a.json", '{"system_prompt": "hi", "params": {"temperature": 0.5}}'), ("p", "b.json", "{"), ("p", "c.json", '{"params": {}}')]
    storage.write_texts(spark.createDataFrame(files, "directory string, name string, content string"), folder)
    got = [(n, storage.read_persona(spark, f"{folder}/p/{n}.json")) for n in "abcd"]
    return spark.createDataFrame([(n, x["system_prompt"], str(x["params"].get("temperature", ""))) for n, x in got], "name string, system_prompt string, temperature string")


@query
def social_update(spark, d):
    """Entities made of nodes, with deep changes made of the last patches: some fields replaced, some added, the others kept."""
    meta = F.struct("layer", F.lit("kept").alias("mark"))
    entities = _now(spark, d, "id", "title", "layer").select("id", F.to_json(F.struct("id", F.coalesce("title", F.lit("")).alias("name"), meta.alias("meta"))).alias("entity"))
    p = table(spark, d, "node_patches").filter("patch_ts is not null").select("id", "patch_ts", "patch_file", "source")
    last = merge.last_writes(p, ["id"], ["patch_ts", "patch_file"])
    change = F.to_json(F.struct(F.array(F.lit("x")).alias("aliases"), F.struct(F.lit("new").alias("layer"), F.coalesce("source", F.lit("none")).alias("source")).alias("meta")))
    out = storage.update_entities(entities, last.select("id", change.alias("change")))
    paths = {"name": "name", "layer": "meta.layer", "mark": "meta.mark", "source": "meta.source", "alias": "aliases[0]"}
    return out.select("id", *[F.get_json_object("entity", f"$.{p}").alias(k) for k, p in paths.items()])


@query
def people_search(spark, d):
    people = _now(spark, d, "id", "title", "source").select("id", F.col("title").alias("name"), F.array("source").alias("aliases"))
    return documents.people(people, "IMPORT").select("id", "name")


@query
def answers_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(markup.answer_cut(F.col("text"))).alias("digest"), F.length(markup.answer_cut(F.col("text"))).alias("n"))


@query
def stream_decoded(spark, d):
    """Texts put together again from server-sent lines of one word each; the end mark comes after fifty words."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "w"))
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat("w", F.lit(" ")).alias("content")).alias("delta"))).alias("choices")))
    chunks = words.select("doc_id", "n", F.explode(F.array(
        F.when(F.col("n") == 50, "data: [DONE]").otherwise(F.concat(F.lit("data: "), delta)), F.lit(": comment"), F.lit("data: {broken"))).alias("line"))
    return documents.stream_text(chunks, "doc_id", "n").select("doc_id", F.md5("content").alias("digest"))


def _task_lists(spark, d):
    """(doc_id, tasks): the contents of the tasks of each list, in order."""
    t = documents.task_lines(table(spark, d, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "content"))).alias("x"))
    return t.select("doc_id", F.transform("x", lambda y: y["content"]).alias("tasks"))


@query
def task_capsules(spark, d):
    paths = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("/dag/a.md"), F.lit("/dag/b.md"))).otherwise(F.array().cast("array<string>"))
    return _task_lists(spark, d).select("doc_id", F.posexplode(documents.capsules(F.col("tasks"), paths)).alias("pos", "task"))


@query
def todo_append(spark, d):
    ids_ = F.transform("tasks", lambda t: F.substring(F.md5(t), 1, 8))
    return _task_lists(spark, d).select("doc_id", documents.append_tasks(F.lit("# list"), F.col("tasks"), ids_).alias("text"))


@query
def report_log(spark, d):
    r = table(spark, d, "documents").filter("text is not null")
    return r.select("doc_id", F.md5(documents.report_entry(F.col("doc_id").cast("string"), F.coalesce("source", F.lit("none")), F.col("text"))).alias("digest"))


@query
def short_ids(spark, d):
    """Drawn ids: all have eight hexadecimal signs."""
    i = table(spark, d, "documents").select(markup.short_uuid().alias("i"))
    return i.agg(F.count("*").alias("n"), F.count_if(F.col("i").rlike("^[0-9a-f]{8}$")).alias("n_good"))


@query
def embeddings_encoded(spark, d):
    """Titles through the encoder whose vectors can be checked; its dimension is that of the result."""
    v = _now(spark, d, "id", "title").select("id", embedding.embed(F.col("title"), embedding.letter_encoder).alias("e"))
    return v.select("id", F.coalesce(F.size("e"), F.lit(-1)).alias("size"), F.array_join(F.transform("e", lambda x: x.cast("int").cast("string")), ",").alias("counts"))


@query
def frontmatter_parse(spark, d):
    m = markup.front_matter(F.col("text"))
    return table(spark, d, "documents").filter(m["valid"]).select("doc_id", *[m[c].alias(c) for c in ("id", "type", "parents", "title")])


@query
def sanitize_id(spark, d):
    return table(spark, d, "edges").select("source_id").distinct().select("source_id", ids.sanitize_id(F.col("source_id")).alias("clean"))


@query
def parents_normalise(spark, d):
    return table(spark, d, "dag_nodes").select("path", ids.normalise_parents(F.col("parents")).alias("parents")).distinct()


def _files(spark, d):
    n = table(spark, d, "dag_nodes")
    layer = F.split("path", "/")[1]
    return n.select("path", "id", layer.alias("layer"), "title", markup.render(F.col("id"), layer, F.col("parents"), F.col("title"), F.col("body")).alias("content"))


@query
def index_map(spark, d):
    return documents.index_lines(documents.node_index(_files(spark, d)))


@query
def node_paths(spark, d):
    return documents.node_index(_files(spark, d)).select("id", "path")


@query
def fetch_truncated(spark, d):
    """Texts of all parents named anywhere, cut if long; unknown ones give an error text."""
    wanted = table(spark, d, "dag_nodes").select(F.explode(F.split(F.coalesce("parents", F.lit("")), ",")).alias("id")).filter("regexp_replace(id, '[^A-Za-z0-9_]', '') <> ''")
    index = documents.node_index(_files(spark, d))
    files = _files(spark, d).select("id", "path", "content").join(index.select("id", "path"), ["id", "path"], "left_semi").groupBy("id").agg(F.max("content").alias("content"))
    return documents.fetch(files, wanted)


@query
def markdown_render(spark, d):
    n = table(spark, d, "dag_nodes").select("id", F.col("type").alias("layer"), "parents", "title", "body").distinct()
    return documents.rendered(n)


@query
def actions_extract(spark, d):
    t = table(spark, d, "documents").select("doc_id", markup.without_reasoning(F.col("text")).alias("text")).filter("text is not null")
    kinds = {"fetch": markup.fetches, "ask": markup.queries_asked}
    parts = [t.select("doc_id", F.lit(k).alias("kind"), F.posexplode(f(F.col("text"))).alias("pos", "value")) for k, f in kinds.items()]
    return parts[0].unionByName(parts[1])


@query
def actions_write(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.posexplode(markup.writes(F.col("text"))).alias("pos", "w")).select("doc_id", "pos", "w.*")


@query
def actions_finish(spark, d):
    """Tasks of finish tags made of the task lists, some with words around the list; and of the texts as they are."""
    tag = F.concat(F.lit("so [ACTION: FINISH("), F.when(F.col("doc_id") % 2 == 0, "done: ").otherwise(""), F.to_json("tasks"), F.lit(")] end"))
    made = _task_lists(spark, d).select("doc_id", tag.alias("text"))
    t = made.unionByName(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", markup.finished(F.col("text")).alias("tasks"))
    return t.filter("tasks is not null").select("doc_id", F.array_join("tasks", "|").alias("tasks"))


@query
def reasoning_stripped(spark, d):
    t = table(spark, d, "documents").filter("contains(text, '</think>')")
    return t.select("doc_id", markup.without_reasoning(F.col("text")).alias("answer"))


@query
def todo_lines(spark, d):
    return documents.task_lines(table(spark, d, "documents")).select("doc_id", "line_no", "pending", "done", "id", "content")


@query
def todo_pop(spark, d):
    return documents.pop_tasks(table(spark, d, "documents").select("doc_id", "text"))[0]


@query
def todo_after_pop(spark, d):
    rest = documents.pop_tasks(table(spark, d, "documents").select("doc_id", "text"))[1]
    return rest.filter("text is not null").select("doc_id", F.md5("text").alias("digest"))


@query
def message_window(spark, d):
    m = table(spark, d, "documents").select("session_id", "created_at", "doc_id")
    return documents.message_window(m, ["session_id"], ["created_at", "doc_id"]).select("session_id", "doc_id", "pos")


@query
def repeat_detect(spark, d):
    m = table(spark, d, "documents").select("session_id", "created_at", "doc_id", "source")
    return documents.repeats(m, ["session_id"], ["created_at", "doc_id"], "source", F.trunc("created_at", "month")).select("session_id", "doc_id", "repeated")


@query
def external_ids(spark, d):
    return _now(spark, d, "id", "title").select("id", markup.external_id(F.coalesce("title", F.lit("")), F.lit(1735689600)).alias("temp_id"))
