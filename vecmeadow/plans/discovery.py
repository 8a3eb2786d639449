"""Novelty and sub-prototype queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmeadow.operators import bank as B, novelty as N, scoring as S, subprototypes as P
from vecmeadow.plans.registry import Tables, query
from vecmeadow.plans.sql import RANKED, UNITS, centroids
from vecmeadow.plans.vectors import CENTRED, FIVE_SHOT, THETA, components, five_shot, long_sql

SIMILAR = 0.4

ADJACENT = CENTRED + f""",
adj AS (SELECT a.vec_id AS i, list(b.vec_id ORDER BY b.vec_id) AS nb FROM centred a JOIN centred b ON list_dot_product(a.v, b.v) >= {SIMILAR} GROUP BY a.vec_id),
ord AS (SELECT i, nb, row_number() OVER (ORDER BY i) AS k FROM adj WHERE len(nb) >= 3),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS leader, []::BIGINT[] AS got UNION ALL
  SELECT k, CASE WHEN ok THEN list_concat(taken, open) ELSE taken END, CASE WHEN ok THEN i END, CASE WHEN ok THEN open ELSE []::BIGINT[] END
  FROM (SELECT o.k, o.i, w.taken, list_filter(o.nb, lambda x: NOT list_contains(w.taken, x)) AS open,
    NOT list_contains(w.taken, o.i) AND len(list_filter(o.nb, lambda x: NOT list_contains(w.taken, x))) >= 3 AS ok
    FROM walk w JOIN ord o ON o.k = w.k + 1)),
members AS (SELECT leader, unnest(got) AS vec_id FROM walk WHERE leader IS NOT NULL)"""


def members(t: Tables):
    return N.leader_clusters(t.embeddings, SIMILAR, 3)


@query(
    "j8_similar_pairs",
    f"WITH {UNITS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS cosine, 1::BIGINT AS copies_a, 1::BIGINT AS copies_b "
    "FROM units a JOIN units b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.3",
)
def _(t):
    return N.similar_pairs(t.embeddings, 0.3).withColumn("cosine", F.round("cosine", 6))


@query("m6_leader_clusters", f"WITH RECURSIVE {ADJACENT} SELECT vec_id, leader FROM members")
def _(t):
    return members(t)


@query(
    "m6_cluster_listing",
    f"WITH RECURSIVE {ADJACENT}, mv AS (SELECT m.leader, m.vec_id, u.v FROM members m JOIN units u USING (vec_id)), "
    + centroids("c", "mv", "leader")
    + ", num AS (SELECT leader, row_number() OVER (ORDER BY leader) AS k FROM c) "
    "SELECT format('Novel_Cluster_{:02d}', num.k) AS cluster_id, n AS n_samples, round(avg_cos, 4) AS cohesion, examples FROM ("
    "SELECT mv.leader, any_value(c.n) AS n, avg(list_dot_product(mv.v, c.c)) AS avg_cos, array_to_string(list(mv.vec_id ORDER BY mv.vec_id)[:5], ',') AS examples "
    "FROM mv JOIN c USING (leader) GROUP BY mv.leader) x JOIN num ON num.leader = x.leader",
)
def _(t):
    """Clusters with size, cohesion and at most five member ids."""
    m = members(t)
    shown = N.example_members(m).groupBy("leader").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string"))).alias("examples")
    )
    return N.describe_clusters(t.embeddings, m).join(shown, "leader").select("cluster_id", "n_samples", "cohesion", "examples")


@query(
    "m7_promote_cluster",
    f"WITH RECURSIVE {ADJACENT}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM units), "
    "mv AS (SELECT (100 + m.leader)::INTEGER AS label, u.v FROM members m JOIN units u USING (vec_id)), "
    + centroids("old", "r", "label", "rn <= 5") + ", " + centroids("new", "mv", "label")
    + ", both_banks AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT label, n AS n_support, round(c[1], 6) AS first_entry FROM both_banks",
)
def _(t):
    """Every cluster joins the five-shot bank as label 100 + leader."""
    bank, _ = five_shot(t)
    m = members(t)
    names = m.select("leader").distinct().withColumn("label", (F.col("leader") + 100).cast("int"))
    grown = N.promote(bank, t.embeddings, m, names)
    return grown.select("label", "n_support", F.round(F.col("centroid")[0], 6).alias("first_entry"))


@query(
    "j10_assign_clusters",
    f"WITH RECURSIVE {ADJACENT} SELECT e.vec_id, coalesce(m.leader, CASE WHEN e.label = 0 THEN -1 END)::BIGINT AS cluster_id FROM embeddings e LEFT JOIN members m USING (vec_id)",
)
def _(t):
    """Rows of label 0 carry an earlier cluster id, which non-members keep."""
    old = t.embeddings.select("vec_id", F.when(F.col("label") == 0, F.lit(-1)).cast("long").alias("cluster_id"))
    return N.assign_clusters(old, members(t)).select("vec_id", "cluster_id")


def lloyd(steps: int, k: int, labels: str = "true") -> str:
    """Unrolled k-means over the labels for which ``labels`` holds: ``k0`` holds the starts, ``k{steps}`` the result."""
    parts = [RANKED, f"k0 AS (SELECT label, rn AS sub, v AS c FROM ranked WHERE rn <= {k} AND {labels})"]
    for i in range(steps):
        parts.append(
            f"a{i} AS (SELECT q.label, q.v, b.sub FROM ranked q JOIN k{i} b USING (label) "
            f"QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, b.c) DESC, b.sub) = 1)"
        )
        parts.append(centroids(f"n{i}", f"a{i}", "label, sub"))
        parts.append(f"k{i + 1} AS (SELECT o.label, o.sub, coalesce(n.c, o.c) AS c FROM k{i} o LEFT JOIN n{i} n USING (label, sub))")
    return ",\n".join(parts)


@query(
    "m4_sub_prototypes",
    f"WITH {lloyd(3, 3)} SELECT label, sub::INTEGER AS sub, i, round(x, 6) AS x FROM (SELECT label, sub, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM k3)",
)
def _(t):
    """Three iterations with k = 3, which the oracle unrolls."""
    return components(P.sub_prototypes(t.embeddings, 3, 3), ["label", "sub"], "centroid")


def converged(k: int, labels: str = "true") -> str:
    """K-means up to the round in which no row changes its centre, as recursion over all rows' centres; at most 50 rounds.

    ``done`` (label, sub, c) holds the centres. One list per round and label has its rows in id order, so a centre is the unit
    sum of the rows that were nearest to it.
    """
    scores = "list_transform(cs, lambda c: list_dot_product(r.v, c))"
    return f"""{RANKED},
packed AS (SELECT label, list({{'v': v}} ORDER BY rn) AS rows, list(v ORDER BY rn)[:{k}] AS start FROM ranked WHERE {labels} GROUP BY label HAVING count(*) >= {k}),
walk AS (SELECT 0 AS step, label, rows, start AS cs, NULL::BIGINT[] AS near FROM packed UNION ALL
  SELECT step + 1, label, rows, list_transform(range(1, {k} + 1), lambda j: CASE WHEN list_contains(now, j) THEN
      list_transform(list_reduce(list_transform(list_filter(list_zip(rows, now), lambda z: z[2] = j), lambda z: z[1].v),
        lambda x, y: list_transform(list_zip(x, y), lambda q: q[1] + q[2])), lambda e: e) ELSE cs[j] END)
      .list_transform(lambda s: list_transform(s, lambda e: e / sqrt(list_dot_product(s, s)))), now
  FROM (SELECT *, list_transform(rows, lambda r: list_position({scores}, list_max({scores}))::BIGINT) AS now FROM walk) w
  WHERE step < 50 AND (near IS NULL OR near <> now)),
done AS (SELECT label, unnest(cs) AS c, generate_subscripts(cs, 1) AS sub FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY label ORDER BY step DESC) = 1))"""


@query(
    "m4_sub_prototypes_converged",
    f"WITH RECURSIVE {converged(3)} SELECT label, sub::INTEGER AS sub, i, round(x, 6) AS x FROM (SELECT label, sub, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM done)",
)
def _(t):
    return components(P.sub_prototypes(t.embeddings, 3, 50), ["label", "sub"], "centroid")


WIDE = (
    "label IN (SELECT u.label FROM units u JOIN mean USING (label) GROUP BY u.label "
    "HAVING var_pop(list_dot_product(u.v, mean.c)) >= 0.0155 AND count(*) >= 2)"
)


@query(
    "m5_adaptive_sub_prototypes",
    "WITH RECURSIVE " + converged(2, WIDE).replace("packed AS", centroids("mean", "units") + ",\npacked AS", 1)
    + ", found AS (SELECT label, sub, c FROM done UNION ALL SELECT label, 1 AS sub, c FROM mean WHERE label NOT IN (SELECT label FROM done)) "
    "SELECT label, sub::INTEGER AS sub, i, round(x, 6) AS x FROM (SELECT label, sub, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM found)",
)
def _(t):
    """A variance bound inside the range of the data, so that some labels split and others do not."""
    return components(P.adaptive_sub_prototypes(t.embeddings, 0.0155, 2), ["label", "sub"], "centroid")


@query(
    "j2_sub_prototype_bank",
    f"WITH {lloyd(2, 2)}, s AS (SELECT q.vec_id, b.label, max(list_dot_product(q.v, b.c)) AS s FROM ranked q, k2 b GROUP BY ALL) "
    "SELECT vec_id, label AS best_label, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1",
)
def _(t):
    """Bank with sub-prototypes from two k-means iterations; a label scores by its best one."""
    bank = P.with_sub_prototypes(B.fit_bank(t.embeddings), P.sub_prototypes(t.embeddings, 2, 2))
    scored = S.score(t.embeddings.select("vec_id", "embedding"), S.sub_rows(bank), k=1)
    return S.decide(scored, 0.0).select("vec_id", "best_label", F.round("score", 6).alias("score"))
