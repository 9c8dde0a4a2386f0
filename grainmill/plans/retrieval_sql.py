"""SQL for the queries in retrieval.py."""

from grainmill.plans.retrieval import AS_OF, ASKED, NOW, PROMOTE, SINCE

CUR = "cur AS (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST) = 1)"


def _iso(c: str) -> str:
    return f"replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '')"


def _clean(c: str) -> str:
    return f"regexp_replace({c}, '[^A-Za-z0-9_]', '', 'g')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _trace(depth: int) -> str:
    return f"""WITH RECURSIVE l AS (SELECT DISTINCT target_id AS c, source_id AS p FROM edges WHERE rel_type = 'DERIVED_FROM' AND source_id IS NOT NULL AND target_id IS NOT NULL),
t AS (SELECT c AS root, p AS id, 1 AS depth FROM l UNION SELECT t.root, l.p, t.depth + 1 FROM t JOIN l ON t.id = l.c WHERE t.depth < {depth})
SELECT root, id, min(depth)::INTEGER AS depth FROM t GROUP BY ALL"""


_TOKENS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', title, summary)), '[^a-z]+'), lambda w: w <> '')"
_ASKED = "fixed(qid, text, vec_id) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in ASKED) + """),
q AS (
  SELECT qid, text, embedding FROM fixed JOIN embeddings USING (vec_id)
  UNION ALL SELECT id, title, embedding FROM cur WHERE try_cast(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0
)"""


def _bm25(tokens: str = _TOKENS) -> str:
    return f"""{CUR},
{_ASKED},
tok AS (SELECT id, is_active, {tokens} AS t FROM cur),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT id, is_active, term, len, count(*) AS tf FROM (SELECT id, is_active, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
ask AS (SELECT qid, unnest({tokens.replace("concat_ws(' ', title, summary)", "coalesce(text, '')")}) AS term FROM q),
bm AS (
  SELECT qid, id, round(sum(log10((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score
  FROM ask JOIN post USING (term) JOIN df USING (term), stats WHERE is_active GROUP BY qid, id
),
fts AS (SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1)::INTEGER AS rank FROM bm QUALIFY rank < 10)"""


_BM25 = _bm25()
_FOLDED = _bm25("list_filter(regexp_split_to_array(strip_accents(lower(concat_ws(' ', title, summary))), '[^a-z]+'), lambda w: w <> '' AND w NOT IN ('the', 'of', 'on', 'and', 'note'))")
_UNIT = """v AS (
  SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT id, embedding::DOUBLE[] AS e FROM cur WHERE is_active AND len(embedding) = 64)
  WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND list_dot_product(e, e) > 0
)"""
_VEC = f"""{_UNIT},
ev AS (
  SELECT qid, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT qid, embedding::DOUBLE[] AS e FROM q WHERE len(embedding) = 64)
  WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND list_dot_product(e, e) > 0
),
vec AS (
  SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) - 1)::INTEGER AS rank
  FROM (SELECT qid, v.id, round(list_dot_product(v.e, ev.e) / (v.n * ev.n), 6) AS similarity FROM ev, v) QUALIFY rank < 10
)"""


def _hybrid(gate: float | None, top: int) -> str:
    weak = "SELECT qid FROM q" if gate is None else f"SELECT q.qid FROM q LEFT JOIN fts USING (qid) GROUP BY q.qid HAVING coalesce(max(score), 0) < {gate}"
    return f"""WITH {_BM25},
{_VEC},
weak AS ({weak}),
parts AS (
  SELECT qid, id, rank AS f, NULL::INTEGER AS v FROM fts UNION ALL SELECT qid, id, NULL, rank FROM vec WHERE qid IN (SELECT qid FROM weak)
),
rrf AS (
  SELECT qid, id, round(sum(coalesce(1.0::DOUBLE / (60 + f), 1.0::DOUBLE / (60 + v))), 6) AS rrf_score, min(f) AS fts_rank, min(v) AS vec_rank FROM parts GROUP BY qid, id
),
top AS (
  SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, fts_rank NULLS LAST, vec_rank NULLS LAST, id) - 1)::INTEGER AS rank FROM rrf QUALIFY rank < {top}
)"""


_RANKS = "coalesce(fts_rank, -1) AS fts_rank, coalesce(vec_rank, -1) AS vec_rank, rank"
_HITS = f" SELECT qid, id, rrf_score, {_RANKS}, title, summary, confidence::DOUBLE AS confidence FROM top JOIN cur USING (id)"
_REC = f"rec AS (SELECT doc_id, session_id, {_iso('created_at')} AS ts, created_at, text AS content, source AS summary, n_chars % 15 AS access_count FROM documents)"
_AGE = f"(date_diff('microsecond', created_at, TIMESTAMP '{AS_OF}') / 86400e6)"


def _share(text: str, words: list[str]) -> str:
    return "least(1.0::DOUBLE, (" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + f") / {len(words)}.0::DOUBLE)"


_DIM = {
    "recency": f"CASE WHEN created_at IS NULL THEN 0.5::DOUBLE WHEN {_AGE} <= 1 THEN 1.0 WHEN {_AGE} <= 7 THEN 0.5 + 0.5 * (7 - {_AGE}) / 6 WHEN {_AGE} <= 30 THEN 0.1 + 0.4 * (30 - {_AGE}) / 23 ELSE 0.1 END",
    "frequency": "least(1.0::DOUBLE, coalesce(access_count, 1) / 10.0::DOUBLE)",
    "relevance": _share("lower(coalesce(content, '') || coalesce(summary, ''))", ["task", "goal", "result", "decision", "conclusion"]),
    "completeness": "((coalesce(session_id, '') <> '')::INT + (ts IS NOT NULL)::INT + (coalesce(content, '') <> '')::INT) / 3.0::DOUBLE",
    "clarity": "CASE WHEN length(coalesce(content, '')) < 100 THEN length(coalesce(content, '')) / 100.0::DOUBLE WHEN length(content) <= 1000 THEN 1.0 ELSE greatest(0.5::DOUBLE, 1 - (length(content) - 1000) / 9000.0::DOUBLE) END",
    "actionability": _share("lower(coalesce(content, ''))", ["should", "must", "will", "decided", "action", "next step", "todo"]),
}
_W = {"recency": 0.2, "frequency": 0.2, "relevance": 0.2, "completeness": 0.15, "clarity": 0.15, "actionability": 0.1}
_SCORE = f"{_REC}, scored AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, " + " + ".join(f"({_DIM[k]})::DOUBLE * {w}::DOUBLE" for k, w in _W.items()) + ")), 6) AS score FROM rec)"


def _counters(t: float) -> str:
    return f"""WITH {_SCORE} SELECT count(DISTINCT session_id) AS processed_sessions, count(*) FILTER (score >= {t}) AS consolidated,
count(*) FILTER (score < {t}) AS discarded, count(*) FILTER (score >= greatest({t}, 0.8)) AS promoted FROM scored"""


_WRITES = """WITH RECURSIVE p AS (SELECT DISTINCT id, patch_ts, patch_file, expected_version FROM node_patches WHERE id IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY patch_ts NULLS FIRST, patch_file NULLS FIRST, expected_version NULLS FIRST) AS seq FROM p),
t AS (
  SELECT id, seq, expected_version, NULL::INTEGER AS actual_version, true AS applied, 1 AS version FROM s WHERE seq = 1
  UNION ALL
  SELECT s.id, s.seq, s.expected_version, t.version, s.expected_version IS NULL OR s.expected_version = t.version,
    CASE WHEN s.expected_version IS NULL OR s.expected_version = t.version THEN t.version + 1 ELSE t.version END
  FROM t JOIN s ON s.id = t.id AND s.seq = t.seq + 1
)"""
_WRITTEN = """WITH RECURSIVE f AS (SELECT min(snapshot_id) AS s FROM node_snapshots),
snap AS (SELECT * FROM node_snapshots WHERE snapshot_id = (SELECT s FROM f) AND id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, type DESC, layer DESC, title DESC, summary DESC, confidence DESC, source DESC, is_active DESC, created_at DESC, updated_at DESC) = 1),
p AS (SELECT DISTINCT id, patch_ts, patch_file, expected_version, type, layer, title, summary, confidence, source FROM node_patches WHERE id IS NOT NULL AND patch_ts > (SELECT strptime(s, '%Y%m%d_%H%M%S') FROM f)),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY patch_ts, patch_file NULLS FIRST, expected_version NULLS FIRST) AS seq FROM p),
t AS (
  SELECT s.id, seq, s.expected_version, snap.version AS actual_version, s.expected_version IS NULL OR snap.id IS NULL OR s.expected_version = snap.version AS applied,
    CASE WHEN s.expected_version IS NULL OR snap.id IS NULL OR s.expected_version = snap.version THEN coalesce(snap.version, 0) + 1 ELSE snap.version END AS version
  FROM s LEFT JOIN snap ON snap.id = s.id WHERE seq = 1
  UNION ALL
  SELECT s.id, s.seq, s.expected_version, t.version, s.expected_version IS NULL OR s.expected_version = t.version,
    CASE WHEN s.expected_version IS NULL OR s.expected_version = t.version THEN t.version + 1 ELSE t.version END
  FROM t JOIN s ON s.id = t.id AND s.seq = t.seq + 1
),
ok AS (SELECT s.*, t.version FROM t JOIN s ON s.id = t.id AND s.seq = t.seq WHERE applied)"""
_ODD = """odd AS (SELECT session_id || '/../x:=%' || (doc_id % 3) AS session_id, text FROM documents),
largest AS (SELECT session_id FROM odd WHERE session_id IS NOT NULL GROUP BY session_id ORDER BY count(*) DESC, session_id LIMIT 1)"""
_GONE = f"gone AS (SELECT DISTINCT {_clean('target_id')} AS id FROM edges WHERE rel_type = 'CONTRADICTS' AND {_clean('target_id')} <> '')"
_LIST = ("type", "layer", "title", "summary", "confidence", "source")
_NP = "np AS (SELECT * FROM node_patches WHERE id IS NOT NULL AND patch_ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY patch_ts DESC, patch_file DESC) = 1)"
_FM = f"""fm AS (
  SELECT doc_id, substr(text, 4, p - 1) AS header, substr(text, p + 6) AS body FROM (SELECT doc_id, text, strpos(substr(text, 4), '---') AS p FROM documents WHERE starts_with(text, '---')) WHERE p > 0
),
fmv AS (SELECT doc_id, regexp_extract(header, 'id:\\s*([a-zA-Z0-9_]+)', 1) AS id, header, {_strip("regexp_extract(body, '(?m)^#\\s+([^\\r\\n]+)', 1)")} AS title FROM fm)"""
_LINES = "ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM documents WHERE text IS NOT NULL))"
_TASK = f"""{_LINES},
tl AS (SELECT doc_id, line_no, line, {_strip('line')} AS t FROM ln),
tr AS (SELECT *, starts_with(t, '- [ ]') AS pending, starts_with(t, '- [x]') AS done, {_strip('substr(t, 6)')} AS rest FROM tl WHERE starts_with(t, '- [ ]') OR starts_with(t, '- [x]')),
tk AS (
  SELECT doc_id, line_no, line, pending, done, CASE WHEN regexp_matches(rest, '^\\[id:[^\\]]*\\]') THEN regexp_extract(rest, '^\\[id:([^\\]]*)\\]', 1) ELSE 'unknown' END AS id,
    CASE WHEN regexp_matches(rest, '^\\[id:[^\\]]*\\]') THEN {_strip("regexp_replace(rest, '^\\[id:[^\\]]*\\]', '')")} ELSE rest END AS content FROM tr
)"""
_ANSWER = f"CASE WHEN contains(text, '</think>') THEN {_strip("list_last(string_split(text, '</think>'))")} ELSE text END"
_NORM = f"array_to_string(list_transform(list_filter(string_split(coalesce(parents, ''), ','), lambda x: trim(x) <> ''), lambda x: {_clean('x')}), ',')"


def _render(layer: str) -> str:
    return f"'---\nid: ' || {_clean('id')} || '\ntype: ' || coalesce({layer}, '') || '\nparents: [' || {_NORM} || ']\n---\n# ' || {_strip("coalesce(title, '')")} || '\n\n' || {_strip("coalesce(body, '')")} || '\n'"


_WRITTEN_FILES = f"""raw AS (SELECT {_clean('id')} AS name, string_split(path, '/')[2] AS layer, {_render("string_split(path, '/')[2]")} AS content FROM dag_nodes),
wf AS (SELECT CASE WHEN layer = 'L2_Engineering' THEN layer ELSE 'L1_Theorems' END AS directory, name, max(content) AS content FROM raw WHERE name <> '' GROUP BY ALL),
cutup AS (SELECT *, substr(content, 4, p - 1) AS header, substr(content, p + 6) AS body FROM (SELECT *, strpos(substr(content, 4), '---') AS p FROM wf)),
parsed AS (SELECT directory, name, content, header, body, regexp_extract(header, 'id:\\s*([a-zA-Z0-9_]+)', 1) AS id, {_strip("regexp_extract(body, '(?m)^#\\s+([^\\r\\n]+)', 1)")} AS title FROM cutup)"""
_FILES = f"files AS (SELECT DISTINCT path, id, string_split(path, '/')[2] AS layer, title, {_render("string_split(path, '/')[2]")} AS content FROM dag_nodes)"
_INDEX = f"{_FILES}, idx AS (SELECT * FROM files WHERE id IS NOT NULL AND title IS NOT NULL AND layer IN ('L0_Axioms', 'L1_Theorems', 'L2_Engineering') QUALIFY row_number() OVER (PARTITION BY id ORDER BY layer DESC, path DESC, title DESC) = 1)"


def _actions(name: str, kind: str, trim: str) -> str:
    found = f"regexp_extract_all(a, '(?i)\\[ACTION:\\s*{name}\\(([^\\n]*?)\\)\\]', 1)"
    return f"SELECT doc_id, '{kind}' AS kind, (unnest(range(len(m))))::INTEGER AS pos, regexp_replace(unnest(m), '{trim}', '', 'g') AS value FROM (SELECT doc_id, {found} AS m FROM ans)"


ORACLE = {
    "nodes_summary_lookup": f"""WITH {CUR} SELECT id, type, layer, title, summary, confidence::DOUBLE AS confidence, source, version,
{_iso('created_at')} AS created_at, {_iso('updated_at')} AS updated_at FROM cur WHERE is_active""",
    "nodes_full_lookup": f"WITH {CUR}, {_GONE} SELECT id, type, title, summary, full_content, version, is_active FROM cur WHERE is_active AND id IN (SELECT id FROM gone)",
    "edges_filter": f"SELECT source_id, target_id, rel_type, {_iso('valid_from')} AS valid_from, {_iso('valid_until')} AS valid_until, properties FROM edges WHERE rel_type = 'CONTRADICTS'",
    "related_nodes": "SELECT DISTINCT source_id AS id, target_id AS related_id FROM edges WHERE rel_type = 'RELATES_TO' AND source_id IS NOT NULL AND target_id IS NOT NULL",
    "trace_depth1": _trace(1), "trace_depth2": _trace(2), "trace_depth3": _trace(3),
    "trace_cyclic": f"SELECT * FROM ({_trace(6)}) WHERE root = id",
    "bm25_topk": f"WITH {_BM25} SELECT qid, id, score, rank FROM fts",
    "bm25_postings_stats": f"WITH {_BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM post GROUP BY term",
    "bm25_corpus": f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "vector_topk": f"""WITH {CUR}, {_UNIT},
ev AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0))
SELECT qid, id, similarity, (row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) - 1)::INTEGER AS rank
FROM (SELECT vec_id AS qid, v.id, round(list_dot_product(v.e, ev.e) / (v.n * ev.n), 6) AS similarity FROM ev, v) QUALIFY rank < 10""",
    "vector_top1_query": """SELECT vec_id AS id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS similarity
FROM embeddings ORDER BY similarity DESC, id LIMIT 10""",
    "vector_dimension": f"WITH {CUR} SELECT max(len(embedding))::INTEGER AS dimension FROM cur",
    "rrf_fusion": _hybrid(None, 1 << 30) + f" SELECT qid, id, rrf_score, {_RANKS} FROM top",
    "hybrid_gated": _hybrid(0.3, 5) + _HITS,
    "hybrid_wide_gate": _hybrid(2.0, 5) + _HITS,
    "hybrid_always": _hybrid(None, 20) + _HITS,
    "hybrid_with_evidence": _hybrid(2.0, 5).replace("WITH ", "WITH RECURSIVE ", 1) + """,
l AS (SELECT DISTINCT target_id AS c, source_id AS p FROM edges WHERE rel_type = 'DERIVED_FROM' AND source_id IS NOT NULL AND target_id IS NOT NULL),
t AS (SELECT c AS root, p AS id, 1 AS depth FROM l WHERE c IN (SELECT id FROM top) UNION SELECT t.root, l.p, t.depth + 1 FROM t JOIN l ON t.id = l.c WHERE t.depth < 3),
ch AS (SELECT root, string_agg(id, ',' ORDER BY id) AS x FROM (SELECT DISTINCT root, id FROM t) GROUP BY root),
rel AS (SELECT id, string_agg(r, ',' ORDER BY r) AS x FROM (SELECT DISTINCT source_id AS id, target_id AS r FROM edges WHERE rel_type = 'RELATES_TO' AND target_id IS NOT NULL) GROUP BY id)
SELECT qid, top.id, rrf_score, coalesce(fts_rank, -1) AS fts_rank, coalesce(vec_rank, -1) AS vec_rank, rank, title, summary, confidence::DOUBLE AS confidence,
coalesce(ch.x, '') AS evidence_chain, coalesce(rel.x, '') AS related_nodes FROM top JOIN cur ON cur.id = top.id LEFT JOIN ch ON ch.root = top.id LEFT JOIN rel ON rel.id = top.id""",
    **{f"score_{k}": f"WITH {_REC} SELECT doc_id, round(({v})::DOUBLE, 6) AS {k} FROM rec" for k, v in _DIM.items()},
    "memory_score": f"WITH {_SCORE} SELECT doc_id, score FROM scored",
    "sleep_light_counters": _counters(0.3), "sleep_rem_counters": _counters(0.5), "sleep_deep_counters": _counters(0.7),
    "sleep_promotions": f"""WITH {_SCORE},
g AS (SELECT 'mem_' || coalesce(session_id, 'unknown') || '_' || coalesce(ts, '') AS id, substr(coalesce(summary, 'Memory'), 1, 100) AS title, substr(coalesce(content, ''), 1, 500) AS summary, score,
  session_id AS record_session_id, ts AS record_ts, content AS record_content, access_count::VARCHAR AS record_access_count FROM scored WHERE score >= {PROMOTE})
SELECT id, 'Memory' AS type, 'L2' AS layer, title, summary, score AS confidence, 'sleep_consolidation' AS source, record_session_id, record_ts, record_content, record_access_count
FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC) = 1""",
    "sleep_sessions_counters": f"""WITH {_SCORE} SELECT (SELECT count(DISTINCT session_id) + 2 FROM scored) AS processed_sessions, count(*) FILTER (score >= 0.5) AS consolidated,
count(*) FILTER (score < 0.5) AS discarded, count(*) FILTER (score >= 0.8) AS promoted FROM scored WHERE session_id IS NOT NULL""",
    "upsert_nodes": f"""WITH {CUR}, {_NP}
SELECT coalesce(c.id, p.id) AS id, {', '.join(f'CASE WHEN p.id IS NOT NULL THEN p.{c} ELSE c.{c} END{"::DOUBLE" if c == "confidence" else ""} AS {c}' for c in _LIST)},
CASE WHEN c.id IS NULL THEN 1 ELSE c.version END AS version, CASE WHEN c.id IS NULL THEN true ELSE c.is_active END AS is_active FROM cur c FULL JOIN np p ON c.id = p.id""",
    "versioned_writes": _WRITES + " SELECT id, seq, coalesce(expected_version, -1) AS expected_version, coalesce(actual_version, -1) AS actual_version, applied, version FROM t",
    "write_conflicts": _WRITES + " SELECT id, seq, expected_version, actual_version FROM t WHERE NOT applied",
    "soft_delete": f"""WITH {CUR}, {_GONE} SELECT id, version, CASE WHEN id IN (SELECT id FROM gone) THEN false ELSE is_active END AS is_active,
{_iso(f"CASE WHEN id IN (SELECT id FROM gone) THEN TIMESTAMP '{NOW}' ELSE updated_at END")} AS updated_at FROM cur""",
    "soft_delete_found": f"WITH {_GONE} SELECT id, id IN (SELECT id FROM nodes WHERE id IS NOT NULL) AS found FROM gone",
    "edge_upsert": f"""SELECT source_id, target_id, rel_type, {_iso('min(valid_from)')} AS valid_from, max_by(coalesce(properties, ''), (valid_from, coalesce(properties, ''))) AS properties
FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND rel_type IS NOT NULL AND valid_from IS NOT NULL GROUP BY source_id, target_id, rel_type""",
    "embedding_update": f"""WITH {CUR}, e AS (SELECT id, version, (CASE WHEN v.vec_id IS NOT NULL THEN v.embedding ELSE cur.embedding END)::DOUBLE[] AS e FROM cur LEFT JOIN embeddings v ON v.vec_id = cur.version)
SELECT id, version, len(e)::INTEGER AS size, round(CASE WHEN len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) THEN list_dot_product(e, range(1, len(e) + 1)::DOUBLE[]) END, 3) AS weighted FROM e""",
    "patch_replay": f"""WITH f AS (SELECT min(snapshot_id) AS s FROM node_snapshots),
snap AS (SELECT * FROM node_snapshots WHERE snapshot_id = (SELECT s FROM f) AND id <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, type DESC, layer DESC, title DESC, summary DESC, confidence DESC, source DESC, is_active DESC, updated_at DESC) = 1),
p AS (SELECT * FROM node_patches WHERE id IS NOT NULL AND patch_ts > (SELECT strptime(s, '%Y%m%d_%H%M%S') FROM f)),
w AS (SELECT *, count(DISTINCT patch_ts) OVER (PARTITION BY id) AS n FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY patch_ts DESC) = 1)
SELECT coalesce(s.id, w.id) AS id, {', '.join(f'CASE WHEN w.id IS NOT NULL THEN w.{c} ELSE s.{c} END{"::DOUBLE" if c == "confidence" else ""} AS {c}' for c in _LIST)},
(CASE WHEN w.id IS NOT NULL THEN coalesce(s.version, 0) + w.n ELSE s.version END)::INTEGER AS version, CASE WHEN s.id IS NULL THEN true ELSE s.is_active END AS is_active,
{_iso('CASE WHEN w.id IS NOT NULL THEN w.patch_ts ELSE s.updated_at END')} AS updated_at FROM snap s FULL JOIN w ON s.id = w.id""",
    "patches_since": f"SELECT DISTINCT patch_file, {_iso('tm')} AS patch_ts FROM (SELECT patch_file, try_cast(string_split(patch_file, '_')[1] AS TIMESTAMP) AS tm FROM node_patches) WHERE tm >= TIMESTAMP '{SINCE}'",
    "patches_to_clean": f"SELECT DISTINCT patch_file FROM node_patches WHERE try_cast(string_split(patch_file, '_')[1] AS TIMESTAMP) < TIMESTAMP '{SINCE}'",
    "snapshot_counts": "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count",
    "snapshot_names": "SELECT DISTINCT strftime(updated_at, '%Y%m%d_%H%M%S') AS name FROM nodes",
    "sessions_list": "SELECT DISTINCT session_id FROM documents WHERE session_id IS NOT NULL",
    "ingest_counts": "SELECT source, count(*) AS n FROM nodes GROUP BY source",
    "frontmatter_parse": f"""WITH {_FM} SELECT doc_id, id, nullif({_strip("regexp_extract(header, '(?m)^type:[ \\t]*([^\\r\\n]*)', 1)")}, '') AS type,
nullif({_strip("regexp_extract(header, '(?m)^parents:[ \\t]*([^\\r\\n]*)', 1)")}, '') AS parents, title FROM fmv WHERE id <> '' AND title <> ''""",
    "sanitize_id": f"SELECT DISTINCT source_id, {_clean('source_id')} AS clean FROM edges",
    "parents_normalise": f"SELECT DISTINCT path, {_NORM} AS parents FROM dag_nodes",
    "index_map": f"WITH {_INDEX} SELECT id, '- [' || id || ']: ' || title AS line FROM idx",
    "node_paths": f"WITH {_INDEX} SELECT id, path FROM idx",
    "fetch_truncated": f"""WITH {_INDEX},
w AS (SELECT DISTINCT {_clean('p')} AS id FROM (SELECT unnest(string_split(parents, ',')) AS p FROM dag_nodes) WHERE {_clean('p')} <> ''),
c AS (SELECT f.id, max(f.content) AS content FROM files f JOIN idx i ON i.id = f.id AND i.path = f.path GROUP BY f.id)
SELECT w.id, CASE WHEN content IS NULL THEN '[DAG Error] 未找到节点: ' || w.id || '。' WHEN length(content) > 1500 THEN substr(content, 1, 1500) || '\n...[已截断]' ELSE content END AS content
FROM w LEFT JOIN c ON c.id = w.id""",
    "markdown_render": f"""SELECT id, directory, CASE WHEN id <> '' THEN content END AS content, CASE WHEN id = '' THEN '[DAG Error] 非法节点 ID。' ELSE '[DAG Success] 节点 ''' || id || ''' 已固化至 ' || coalesce(layer, 'L1_Theorems') || '。' END AS message
FROM (SELECT {_clean('id')} AS id, type AS layer, CASE WHEN type = 'L2_Engineering' THEN 'L2_Engineering' ELSE 'L1_Theorems' END AS directory, {_render('type')} AS content FROM (SELECT DISTINCT id, type, parents, title, body FROM dag_nodes))""",
    "actions_extract": f"WITH ans AS (SELECT doc_id, {_ANSWER} AS a FROM documents WHERE text IS NOT NULL) " + _actions("FETCH", "fetch", "^[ \"'']+|[ \"'']+$") + " UNION ALL " + _actions("TENTACLE", "ask", "^\\s+|\\s+$"),
    "actions_write": f"""WITH m AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?is)\\[ACTION:\\s*WRITE_NODE\\((.*?)\\)\\]', 1), lambda x: string_split(x, ';;')), lambda x: len(x) >= 4) AS w FROM documents),
e AS (SELECT doc_id, (unnest(range(len(w))))::INTEGER AS pos, unnest(w) AS p FROM m)
SELECT doc_id, pos, {_strip('p[1]')} AS id, {_strip('p[2]')} AS title, {_strip('p[3]')} AS parents, {_strip("array_to_string(p[4:], ';;')")} AS body FROM e""",
    "reasoning_stripped": f"SELECT doc_id, {_ANSWER} AS answer FROM documents WHERE contains(text, '</think>')",
    "todo_lines": f"WITH {_TASK} SELECT doc_id, line_no::INTEGER AS line_no, pending, done, id, content FROM tk",
    "todo_pop": f"WITH {_TASK} SELECT doc_id, id, content FROM tk WHERE pending QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1",
    "todo_after_pop": f"""WITH {_TASK}, f AS (SELECT doc_id, min(line_no) AS n FROM tk WHERE pending GROUP BY doc_id),
j AS (SELECT ln.doc_id, string_agg(CASE WHEN line_no = n THEN regexp_replace(line, '- \\[ \\]', '- [x]') ELSE line END, '\n' ORDER BY line_no) || '\n' AS t FROM ln JOIN f ON f.doc_id = ln.doc_id GROUP BY ln.doc_id)
SELECT d.doc_id, md5(coalesce(j.t, d.text)) AS digest FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id WHERE d.text IS NOT NULL""",
    "actions_finish": f"""WITH {_TASK},
made AS (SELECT doc_id, 'so [ACTION: FINISH(' || CASE WHEN doc_id % 2 = 0 THEN 'done: ' ELSE '' END || to_json(list(content ORDER BY line_no))::VARCHAR || ')] end' AS text FROM tk GROUP BY doc_id),
x AS (SELECT doc_id, regexp_extract(text, '(?is)\\[ACTION:\\s*FINISH\\((.*?)\\)\\]', 1) AS t FROM (SELECT * FROM made UNION ALL SELECT doc_id, text FROM documents)),
y AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t ELSE regexp_extract(t, '(?s)(\\[.*\\])', 1) END AS t FROM x WHERE t <> '')
SELECT doc_id, array_to_string(json_extract_string(t, '$[*]'), '|') AS tasks FROM y WHERE json_valid(t) AND len(json_extract_string(t, '$[*]')) > 0""",
    "message_window": """WITH m AS (
  SELECT session_id, doc_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS FIRST, doc_id) AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM documents WHERE session_id IS NOT NULL
) SELECT session_id, doc_id, pos::INTEGER AS pos FROM m WHERE n <= 7 OR pos = 1 OR pos > n - 4""",
    "repeat_detect": """SELECT session_id, doc_id, coalesce(lag(source) OVER (PARTITION BY session_id ORDER BY created_at NULLS FIRST, doc_id) = source, false) AS repeated
FROM documents WHERE session_id IS NOT NULL""",
    "external_ids": f"WITH {CUR} SELECT id, 'ext_' || substr(regexp_replace(coalesce(title, ''), '[^a-zA-Z0-9]', '_', 'g'), 1, 15) || '_1735689600' AS temp_id FROM cur",
    "bm25_folded": f"WITH {_FOLDED} SELECT qid, id, score, rank FROM fts",
    "search_response": _hybrid(0.3, 7) + ", hit AS (SELECT qid, string_agg(top.id, ',' ORDER BY rank) AS ids, count(*)::INTEGER AS total FROM top GROUP BY qid) SELECT q.qid, coalesce(ids, '') AS ids, coalesce(total, 0) AS total FROM q LEFT JOIN hit USING (qid)",
    "session_store": f"""WITH {_REC} SELECT session_id || '/../x:=%' || (doc_id % 3) AS session_id, replace('{NOW}', ' ', 'T') AS ts, md5(content) AS digest, summary, coalesce(access_count, -1) AS access_count FROM rec""",
    "session_read": f"""WITH {_ODD} SELECT session_id, md5(text) AS digest FROM odd WHERE session_id = (SELECT session_id FROM largest)""",
    "session_delete": f"""WITH {_ODD} SELECT session_id, count(*) AS n, 'true,false,false,false' AS found FROM odd WHERE session_id IS DISTINCT FROM (SELECT session_id FROM largest) GROUP BY session_id""",
    "patch_log_list": f"SELECT DISTINCT {_iso('patch_ts')} || '_patch.json' AS patch_file, {_iso('patch_ts')} AS patch_ts FROM node_patches WHERE patch_ts >= TIMESTAMP '{SINCE}'",
    "patch_log_read": f"""SELECT {_iso('patch_ts')} || '_patch.json' AS patch_file, id, type, layer, title, summary, source, round(confidence::DOUBLE, 4) AS confidence, coalesce(expected_version, -1) AS expected_version
FROM node_patches WHERE patch_ts IS NOT NULL""",
    "patch_log_valid": "SELECT count(*) AS n_valid FROM node_patches WHERE patch_ts IS NOT NULL",
    "patch_log_cleaned": f"""SELECT {_iso('patch_ts')} || '_patch.json' AS patch_file, count(*) AS n, (SELECT count(DISTINCT patch_ts) FROM node_patches WHERE patch_ts < TIMESTAMP '{SINCE}') AS n_deleted
FROM node_patches WHERE patch_ts >= TIMESTAMP '{SINCE}' GROUP BY patch_ts""",
    "snapshot_store": "SELECT 'node' AS kind, id, md5(full_content) AS digest FROM nodes UNION ALL SELECT 'edge', source_id, md5(concat_ws('|', target_id, rel_type, properties)) FROM edges",
    "nodes_written": _WRITTEN + f""",
la AS (SELECT id, max(version) AS version, max(patch_ts) AS last_ts, min(patch_ts) AS first_ts, {', '.join(f"(list({c} ORDER BY seq DESC))[1] AS {c}" for c in _LIST)} FROM ok GROUP BY id)
SELECT coalesce(s.id, la.id) AS id, {', '.join(f'CASE WHEN la.id IS NOT NULL THEN la.{c} ELSE s.{c} END{"::DOUBLE" if c == "confidence" else ""} AS {c}' for c in _LIST)},
coalesce(la.version, s.version) AS version, CASE WHEN s.id IS NULL THEN true ELSE s.is_active END AS is_active,
{_iso('CASE WHEN s.id IS NULL THEN first_ts ELSE coalesce(s.created_at, CASE WHEN s.id IS NULL THEN first_ts END) END')} AS created_at, {_iso('coalesce(last_ts, s.updated_at)')} AS updated_at FROM snap s FULL JOIN la ON la.id = s.id""",
    "patches_accepted": _WRITTEN + " SELECT id, seq, version, patch_file, title FROM ok",
    "writes_refused": _WRITTEN + " SELECT id, seq, expected_version, actual_version FROM t WHERE NOT applied",
    "markdown_files": f"""WITH {_WRITTEN_FILES}
SELECT id, nullif({_strip("regexp_extract(header, '(?m)^type:[ \\t]*([^\\r\\n]*)', 1)")}, '') AS type, nullif({_strip("regexp_extract(header, '(?m)^parents:[ \\t]*([^\\r\\n]*)', 1)")}, '') AS parents,
title, md5(content) AS digest, directory AS layer FROM parsed WHERE title <> ''""",
    "markdown_import": f"""WITH {_WRITTEN_FILES}, {CUR},
imp AS (
  SELECT name AS id, 'L1' AS layer, name AS title, '' AS summary, {_strip('body')} AS full_content, 'local_import' AS source FROM parsed QUALIFY row_number() OVER (PARTITION BY name ORDER BY directory DESC) = 1
  UNION ALL SELECT id, 'L0', {_strip('title')}, 'of ' || id, {_strip('body')}, 'github_wiki' FROM axioms
)
SELECT coalesce(i.id, c.id) AS id, CASE WHEN i.id IS NOT NULL THEN 'Concept' ELSE type END AS type, {', '.join(f'CASE WHEN i.id IS NOT NULL THEN i.{c} ELSE c.{c} END AS {c}' for c in ('layer', 'title', 'summary', 'source'))},
md5(CASE WHEN i.id IS NOT NULL THEN i.full_content ELSE c.full_content END) AS digest, CASE WHEN i.id IS NOT NULL THEN 1.0 ELSE confidence END::DOUBLE AS confidence,
CASE WHEN c.id IS NULL THEN 1 ELSE version END AS version, CASE WHEN c.id IS NULL THEN true ELSE is_active END AS is_active FROM cur c FULL JOIN imp i ON i.id = c.id""",
    "markdown_import_counts": f"WITH {_WRITTEN_FILES} SELECT 'local_import' AS source, count(DISTINCT name) AS n FROM parsed UNION ALL SELECT 'github_wiki', count(*) FROM axioms",
    "memory_files": """SELECT * FROM (VALUES ('gene_lock', '# 基因锁 (Gene Lock)\n\n1. 绝对服从指令。\n2. 生产环境操作必须先备份。'), ('hippocampus', '# Hippocampus\n\n'), ('long_term', '# Long_term\n\n'),
('no such kind', ''), ('todo', 'first\n' || (SELECT min(title) FROM axioms) || '\n')) AS t(kind, content)""",
    "personas": """SELECT doc_id, CASE WHEN json_valid(text) THEN coalesce(json_extract_string(text, '$.system_prompt'), '') ELSE '' END AS system_prompt,
CASE WHEN json_valid(text) THEN coalesce(json_extract(text, '$.params')::VARCHAR, '{}') ELSE '{}' END AS params FROM documents WHERE source = 'persona'""",
    "persona_file": "SELECT * FROM (VALUES ('a', 'hi', '0.5'), ('b', '', ''), ('c', '', ''), ('d', '', '')) AS t(name, system_prompt, temperature)",
    "social_update": f"""WITH {CUR}, {_NP} SELECT c.id, coalesce(c.title, '') AS name, CASE WHEN p.id IS NOT NULL THEN 'new' ELSE c.layer END AS layer, 'kept' AS mark,
CASE WHEN p.id IS NOT NULL THEN coalesce(p.source, 'none') END AS source, CASE WHEN p.id IS NOT NULL THEN 'x' END AS alias FROM cur c LEFT JOIN np p ON p.id = c.id""",
    "people_search": f"WITH {CUR} SELECT id, title AS name FROM cur WHERE title ILIKE '%import%' OR source ILIKE '%import%'",
    "answers_cut": "SELECT doc_id, md5(substr(text, 1, 2000)) AS digest, length(substr(text, 1, 2000))::INTEGER AS n FROM documents",
    "stream_decoded": "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ' ')[1:50], lambda w: w || ' '), '')) AS digest FROM documents WHERE text IS NOT NULL",
    "task_capsules": f"""WITH {_TASK} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INTEGER AS pos,
content || CASE WHEN doc_id % 2 = 0 THEN '\n\n【前置强制要求】请使用 toolkit.read_file 优先读取以下设计蓝图，确保命名、接口和技术约束绝对一致：\n  - /dag/a.md\n  - /dag/b.md' ELSE '' END AS task FROM tk""",
    "todo_append": f"WITH {_TASK} SELECT doc_id, '# list\n' || string_agg('- [ ][id:' || substr(md5(content), 1, 8) || '] ' || content, '\n' ORDER BY line_no) || '\n' AS text FROM tk GROUP BY doc_id",
    "report_log": "SELECT doc_id, md5('【任务汇报 - ID:' || doc_id || ' | 状态:' || coalesce(source, 'none') || '】:\n' || text) AS digest FROM documents WHERE text IS NOT NULL",
    "short_ids": "SELECT count(*) AS n, count(*) AS n_good FROM documents",
    "embeddings_encoded": f"""WITH {CUR} SELECT id, CASE WHEN title IS NULL THEN -1 ELSE 26 END AS size,
array_to_string(list_transform(range(97, 123), lambda c: length(lower(title)) - length(replace(lower(title), chr(c::INTEGER), ''))), ',') AS counts FROM cur""",
}
