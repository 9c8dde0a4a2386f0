"""Queries of the llm problems and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import bpe, language, neardup, packing, vectors
from grainmill.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(vectors.current(table(spark, d, "nodes")))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbour_lists(vectors.current(table(spark, d, "nodes")))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_classes(vectors.current(table(spark, d, "nodes")))


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(neardup.records(table(spark, d, "nodes")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decode(p7_ids(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_containers(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """The containers against the lengths of the token lists."""
    lengths = p7_ids(spark, d).select("doc_id", F.size("ids").alias("n_tokens"))
    return packing.checks(cut(p8_containers(spark, d)), lengths)


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(p9_segments(spark, d))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(p9_segments(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p1_found, p1_neighbours, p1_classes, p4_found, p4_groups, p7_ids, p7_decoded, p8_containers, p8_fill, p8_checks, p9_found, p9_segments, p9_documents)
}

_CURRENT = """cur AS (
  SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1
)"""

_VECTORS = f"""{_CURRENT},
v AS (
  SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT id, embedding::DOUBLE[] AS e FROM cur WHERE is_active AND len(embedding) = 64)
  WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND list_dot_product(e, e) > 0
),
near AS (SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.id < b.id AND list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n - 1e-12)"""

_PAIRS = f"""{_CURRENT},
w AS (
  SELECT id, regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(full_content, ''))), '[a-z0-9]+|[\\x{{4E00}}-\\x{{9FFF}}]') AS w FROM cur
),
sh AS (
  SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 30)
),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * c >= x.n + y.n - c)"""

ORACLE = {
    "p1_found": f"WITH {_VECTORS} SELECT id_a, id_b FROM near",
    "p1_classes": f"""WITH {_VECTORS},
cl AS (SELECT id, e, min(id) OVER (PARTITION BY e) AS class_id FROM v),
n AS (SELECT class_id, count(DISTINCT other) AS n FROM (
  SELECT x.class_id, y.class_id AS other FROM near JOIN cl x ON x.id = id_a JOIN cl y ON y.id = id_b UNION ALL SELECT y.class_id, x.class_id FROM near JOIN cl x ON x.id = id_a JOIN cl y ON y.id = id_b
) WHERE class_id <> other GROUP BY class_id)
SELECT id, class_id, coalesce(n, 0) AS n_links FROM cl LEFT JOIN n USING (class_id)""",
    "p4_found": f"""WITH {_PAIRS} SELECT * FROM pairs""",
    "p4_groups": f"""WITH RECURSIVE {_PAIRS},
both_ways AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, p.b FROM reach r JOIN both_ways p ON r.b = p.a),
other AS (SELECT a, count(DISTINCT t.w) AS n FROM both_ways p JOIN w o ON o.id = p.a JOIN w t ON t.id = p.b WHERE o.w <> t.w GROUP BY a)
SELECT g.a AS id, min(g.b) AS group_id, coalesce(any_value(o.n), 0) AS n_links FROM reach g LEFT JOIN other o ON o.a = g.a GROUP BY g.a""",
    "p8_checks": "SELECT count(*) AS n_documents, 0::BIGINT AS n_changed, 0::BIGINT AS n_split, 0::BIGINT AS n_gaps, 0::BIGINT AS n_overfull FROM documents",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
