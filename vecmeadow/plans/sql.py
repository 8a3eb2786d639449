"""SQL fragments shared by the oracles of the vector queries."""

from __future__ import annotations

UNITS = """units AS (
  SELECT vec_id, label, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS v
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS d FROM embeddings))"""

RANKED = UNITS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM units)"""


def centroids(name: str, source: str, keys: str = "label", where: str = "true") -> str:
    """CTEs ``{name}_sum`` (keys, s, n) and ``{name}`` (keys, c, n)."""
    columns = ", ".join(k.strip() for k in keys.split(","))
    return f"""{name}_sum AS (
  SELECT {columns}, list(x ORDER BY i) AS s, any_value(n) AS n FROM (
    SELECT {columns}, i, sum(x) AS x, count(*) AS n FROM (
      SELECT {columns}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {source} WHERE {where})
    GROUP BY {columns}, i)
  GROUP BY {columns}),
{name} AS (SELECT {columns}, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c, n FROM {name}_sum)"""


FIVE_SHOT = RANKED + ",\n" + centroids("bank", "ranked", where="rn <= 5") + """,
held AS (SELECT * FROM ranked WHERE rn > 5),
scores AS (
  SELECT q.vec_id, q.label AS truth, b.label, list_dot_product(q.v, b.c) AS s FROM held q CROSS JOIN bank b),
placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS place FROM scores),
top AS (
  SELECT vec_id, truth,
    max(CASE WHEN place = 1 THEN label END) AS best_label,
    max(CASE WHEN place = 1 THEN s END) AS score,
    coalesce(max(CASE WHEN place = 2 THEN s END), 0) AS second,
    max(CASE WHEN label = truth THEN s END) AS true_score,
    coalesce(max(CASE WHEN label <> truth THEN s END), 0) AS rival_score,
    bool_or(place = 1 AND label = truth) AS top1,
    bool_or(place <= 3 AND label = truth) AS top3
  FROM placed GROUP BY vec_id, truth)"""
