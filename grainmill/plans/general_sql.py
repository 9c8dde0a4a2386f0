"""SQL for the queries in general.py, written without the operators' methods."""

_KNOWN = "known AS (SELECT DISTINCT id FROM (SELECT id FROM nodes UNION ALL SELECT id FROM dag_nodes UNION ALL SELECT id FROM axioms) WHERE id IS NOT NULL)"
_CLEAN = "regexp_replace({}, '[^A-Za-z0-9_]', '', 'g')"
_LINKS = f"""{_KNOWN},
raw AS (
  SELECT {_CLEAN.format('target_id')} AS child, {_CLEAN.format('source_id')} AS parent FROM edges WHERE rel_type = 'DERIVED_FROM'
  UNION ALL
  SELECT {_CLEAN.format('id')}, {_CLEAN.format('p')} FROM (SELECT id, unnest(string_split(parents, ',')) AS p FROM dag_nodes)
),
links AS (SELECT DISTINCT child, parent FROM raw WHERE child IN (SELECT id FROM known) AND parent IN (SELECT id FROM known))"""

#: Longer shortest ways than this don't occur in data of the size at which this SQL is run.
_DEEPEST = 200

_P2 = f"""WITH RECURSIVE {_LINKS},
roots AS (SELECT DISTINCT parent AS root FROM links WHERE parent NOT IN (SELECT child FROM links)),
reach AS (
  SELECT parent AS a, child AS b FROM links
  UNION
  SELECT r.a, l.child FROM reach r JOIN links l ON r.b = l.parent
),
oncycle AS (SELECT DISTINCT a AS node FROM reach WHERE a = b),
down AS (
  SELECT root, root AS node, 0 AS depth FROM roots
  UNION
  SELECT d.root, l.child, d.depth + 1 FROM down d JOIN links l ON d.node = l.parent WHERE d.depth < {_DEEPEST}
),
best AS (SELECT node, root, min(depth) AS depth FROM down WHERE depth > 0 GROUP BY ALL)"""

_P6_STATE = ", ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in ("type", "layer", "title", "summary", "confidence", "source", "is_active"))
_P6 = f"""WITH s AS (
  SELECT * FROM node_snapshots WHERE id IS NOT NULL AND id <> '' AND snapshot_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, id ORDER BY version DESC NULLS LAST, updated_at DESC NULLS LAST) = 1
),
pairs AS (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS before FROM (SELECT DISTINCT snapshot_id FROM s)),
found AS (
  SELECT p.snapshot_id, a.id, CASE WHEN b.id IS NULL THEN 'added' WHEN {_P6_STATE.replace(', ', ' OR ')} THEN 'changed' END AS change
  FROM pairs p JOIN s a ON a.snapshot_id = p.snapshot_id LEFT JOIN s b ON b.snapshot_id = p.before AND b.id = a.id WHERE p.before IS NOT NULL
  UNION ALL
  SELECT p.snapshot_id, b.id, 'removed' FROM pairs p JOIN s b ON b.snapshot_id = p.before
  WHERE NOT EXISTS (SELECT 1 FROM s a WHERE a.snapshot_id = p.snapshot_id AND a.id = b.id)
)"""

_P3 = f"""WITH {_KNOWN},
refs AS (
  SELECT 'edges' AS ref_table, 'source_id' AS ref_field, source_id AS raw, valid_from AS tm FROM edges
  UNION ALL SELECT 'edges', 'target_id', target_id, valid_from FROM edges
  UNION ALL SELECT 'dag_nodes', 'parents', unnest(string_split(parents, ',')), mtime FROM dag_nodes
),
r AS (SELECT ref_table, ref_field, {_CLEAN.format('raw')} AS ref_id, tm, coalesce(strftime(tm, '%Y-%m'), 'unknown') AS period FROM refs),
cur AS (SELECT DISTINCT id, is_active FROM nodes QUALIFY rank() OVER (PARTITION BY id ORDER BY version DESC) = 1),
since AS (SELECT id, min(created_at) AS tm FROM nodes GROUP BY id UNION ALL SELECT id, min(mtime) FROM dag_nodes GROUP BY id),
found AS (
  SELECT DISTINCT ref_table, ref_field, ref_id, period,
    CASE WHEN k.id IS NULL THEN 'missing' WHEN c.id IS NOT NULL AND NOT c.is_active THEN 'deleted' WHEN s.tm > r.tm THEN 'late' END AS kind
  FROM r LEFT JOIN known k ON k.id = r.ref_id LEFT JOIN cur c ON c.id = r.ref_id LEFT JOIN since s ON s.id = r.ref_id
  WHERE r.ref_id <> ''
)"""

_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_NODE_STATE = "(type, layer, title, summary, confidence, source)"
_P5_NODES = f"""np AS (
  SELECT * FROM node_patches WHERE id IS NOT NULL AND id <> '' AND version IS NOT NULL AND patch_ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY patch_ts DESC) = 1
),
nflag AS (
  SELECT id, version, patch_ts, type, layer, title, source, summary, confidence,
    lag(version) OVER w IS NULL OR {' OR '.join(f'{c} IS DISTINCT FROM lag({c}) OVER w' for c in ('type', 'layer', 'title', 'source'))} AS described,
    lag(version) OVER w IS NULL OR {' OR '.join(f'{c} IS DISTINCT FROM lag({c}) OVER w' for c in ('summary', 'confidence'))} AS rated
  FROM np WINDOW w AS (PARTITION BY id ORDER BY version)
)"""
_P5 = f"""WITH raw AS (
  SELECT {_CLEAN.format('source_id')} AS s, {_CLEAN.format('target_id')} AS t, coalesce(rel_type, '') AS rel, valid_from AS tm, valid_until AS until,
    json(properties) AS p FROM edges
),
flat AS (
  SELECT s, t, rel, tm, until, p, CASE WHEN p IS NULL THEN NULL ELSE
    to_json(list_sort([k || '=' || coalesce((p -> k)::VARCHAR, 'null') FOR k IN json_keys(p)]))::VARCHAR END AS state
  FROM raw WHERE s <> '' AND t <> '' AND tm IS NOT NULL
),
one AS (SELECT s, t, rel, tm, max(until) AS until, max(state) AS state, max_by(p, state) AS kept FROM flat GROUP BY s, t, rel, tm),
ended AS (
  SELECT *, CASE WHEN until > tm AND (nxt IS NULL OR until < nxt) THEN until ELSE nxt END AS ends
  FROM (SELECT *, lead(tm) OVER (PARTITION BY s, t, rel ORDER BY tm) AS nxt FROM one)
),
flagged AS (
  SELECT *, CASE WHEN lag(tm) OVER w IS NULL OR lag(state) OVER w IS DISTINCT FROM state OR lag(ends) OVER w <> tm THEN 1 ELSE 0 END AS fresh
  FROM ended WINDOW w AS (PARTITION BY s, t, rel ORDER BY tm)
),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY s, t, rel ORDER BY tm ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
ev AS (
  SELECT s || '|' || t || '|' || rel AS k, run, min(tm) AS tm, CASE WHEN bool_or(ends IS NULL) THEN NULL ELSE max(ends) END AS ends
  FROM runs GROUP BY s, t, rel, run
),
{_P5_NODES},
nv AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY version) AS run, patch_ts AS tm, lead(patch_ts) OVER (PARTITION BY id ORDER BY version) AS ends
  FROM nflag WHERE described OR rated
),
allv AS (SELECT 'edge' AS entity, k, run, tm, ends FROM ev UNION ALL SELECT 'node', id, run, tm, ends FROM nv)
SELECT entity, k AS entity_key, run::INTEGER AS version_no, {_STAMP.format('tm')} AS valid_from, coalesce({_STAMP.format('ends')}, '') AS valid_until
FROM allv QUALIFY count(*) OVER (PARTITION BY entity, k) > 1"""

ORACLE = {
    "p2_found": _P2 + """
SELECT node AS node_id, root AS root_id, depth::INTEGER AS depth FROM best WHERE node NOT IN (SELECT node FROM oncycle)
UNION ALL SELECT node, 'cycle', -1 FROM oncycle
UNION ALL SELECT DISTINCT child, 'below_cycle', -1 FROM links WHERE child NOT IN (SELECT node FROM oncycle) AND child NOT IN (SELECT node FROM best)""",
    "p2_descendants": f"""WITH RECURSIVE {_LINKS},
reach AS (
  SELECT parent AS a, child AS b, 1 AS depth FROM links
  UNION
  SELECT r.a, l.child, r.depth + 1 FROM reach r JOIN links l ON r.b = l.parent WHERE r.depth < {_DEEPEST}
)
SELECT a AS node_id, b AS descendant_id, min(depth)::INTEGER AS depth FROM reach GROUP BY ALL""",
    "p3_found": _P3 + " SELECT * FROM found WHERE kind IS NOT NULL",
    "p3_report": _P3 + " SELECT ref_table, ref_field, period, kind, count(*) AS n_ids FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "p5_found": _P5,
    "p5_satellites": f"""WITH {_P5_NODES},
d AS (SELECT *, lead(patch_ts) OVER (PARTITION BY id ORDER BY version) AS ends FROM nflag WHERE described),
r AS (SELECT *, lead(patch_ts) OVER (PARTITION BY id ORDER BY version) AS ends FROM nflag WHERE rated)
SELECT id, version, 'described' AS satellite, {_STAMP.format('patch_ts')} AS load_ts, coalesce({_STAMP.format('ends')}, '') AS until_ts, type, layer, title, source, NULL AS summary, NULL::DOUBLE AS confidence FROM d
UNION ALL SELECT id, version, 'rated', {_STAMP.format('patch_ts')}, coalesce({_STAMP.format('ends')}, ''), NULL, NULL, NULL, NULL, summary, confidence::DOUBLE FROM r""",
    "p5_appended": f"""WITH {_P5_NODES} SELECT id, count(*) AS n_rows, max(version) AS version, (list(summary ORDER BY version DESC))[1] AS summary, 0::BIGINT AS n_late FROM nflag WHERE rated GROUP BY id""",
    "p5_links": _P5[: _P5.index("ev AS (")].rstrip().rstrip(",") + f""",
opened AS (SELECT s || '|' || t || '|' || rel AS k, tm, false AS closes, json_extract_string(kept, '$.by') AS author FROM runs WHERE fresh = 1),
closed AS (SELECT s || '|' || t || '|' || rel, until, true, NULL FROM runs WHERE until > tm AND (nxt IS NULL OR until < nxt))
SELECT k AS entity_key, {_STAMP.format('tm')} AS load_ts, closes, author FROM (SELECT * FROM opened UNION ALL SELECT * FROM closed)""",
    "p6_found": _P6 + " SELECT * FROM found WHERE change IS NOT NULL",
    "p6_counts": _P6 + " SELECT snapshot_id, change, count(*) AS n_ids FROM found WHERE change IS NOT NULL GROUP BY ALL",
}
ORACLE["p2_paths"] = _P2 + f""",
walk AS (
  SELECT root AS root_id, root AS node_id, 0 AS depth, root AS path FROM roots
  UNION ALL
  SELECT w.root_id, l.child, w.depth + 1, w.path || '/' || l.child FROM walk w JOIN links l ON w.node_id = l.parent
  JOIN best b ON b.node = l.child AND b.root = w.root_id AND b.depth = w.depth + 1
)
SELECT node_id, root_id, depth::INTEGER AS depth, arg_min(path, string_split(path, '/')) AS path FROM walk WHERE depth > 0 AND node_id NOT IN (SELECT node FROM oncycle) GROUP BY ALL
UNION ALL SELECT node, 'cycle', -1, '' FROM oncycle
UNION ALL SELECT DISTINCT child, 'below_cycle', -1, '' FROM links WHERE child NOT IN (SELECT node FROM oncycle) AND child NOT IN (SELECT node FROM best)"""
