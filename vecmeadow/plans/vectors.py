"""Vector queries: normalisation, banks, scoring and evaluation on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.functions import vectors as V
from vecmeadow.operators import audit, bank as B, evaluate as E, scoring as S
from vecmeadow.operators.ordered import first_rows
from vecmeadow.plans.registry import Tables, query
from vecmeadow.plans.sql import FIVE_SHOT, RANKED, UNITS, centroids
from vecmeadow.session import checkpointed

THETA = 0.2
MARGIN = 0.02
SWEEP = [i / 50 for i in range(51)]
CUTS = [0.5, 0.525, 0.55, 0.575, 0.6]


def components(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One rounded row per vector entry, so that engines can be compared."""
    return df.select(*keys, F.posexplode(vector).alias("p", "x")).select(
        *keys, (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x")
    )


def five_shot(t: Tables) -> tuple[DataFrame, DataFrame]:
    enrolled, held = B.enrol_split(t.embeddings, 5)
    return B.fit_bank(enrolled), held


def scored_five_shot(t: Tables, k: int = 3) -> DataFrame:
    bank, held = five_shot(t)
    return S.score(held, bank, k=k, truth="label")


def long_sql(source: str, keys: str, vector: str) -> str:
    return (
        f"SELECT {keys}, i, round(x, 6) AS x FROM (SELECT {keys}, unnest({vector}) AS x, "
        f"generate_subscripts({vector}, 1) AS i FROM {source})"
    )


@query("p1_l2_normalise", f"WITH {UNITS} {long_sql('units', 'vec_id', 'v')}")
def _(t):
    return components(t.embeddings.select("vec_id", V.l2(F.col("embedding")).alias("v")), ["vec_id"], "v")


@query(
    "p2_l2_keep_zero",
    "WITH z AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN label = 0 THEN 0.0 ELSE x END) AS d "
    "FROM embeddings), n AS (SELECT vec_id, CASE WHEN list_dot_product(d, d) = 0 THEN d ELSE "
    "list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) END AS v FROM z) "
    "SELECT vec_id, round(list_dot_product(v, v), 6) AS squared_norm, round(v[1], 6) AS first_entry FROM n",
)
def _(t):
    """Zero vectors (label 0 is blanked) stay zero under ``zero="keep"``."""
    blanked = F.transform(V.doubles(F.col("embedding")), lambda x: F.when(F.col("label") == 0, 0.0).otherwise(x))
    df = t.embeddings.select("vec_id", V.l2(blanked, zero="keep").alias("v"))
    return df.select(
        "vec_id", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("squared_norm"), F.round(F.col("v")[0], 6).alias("first_entry")
    )


@query(
    "p3_dimension_check",
    "SELECT label, count(*) AS n, sum(CASE WHEN len(embedding) = 64 THEN 1 ELSE 0 END)::BIGINT AS right_size FROM embeddings GROUP BY label",
)
def _(t):
    ok = V.of_dimension(V.require_dimension(F.col("embedding"), 64), 64)
    return t.embeddings.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("right_size")
    )


CENTRED = UNITS + """,
mean_sum AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (
  SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM units) GROUP BY i)),
raw_centred AS (SELECT vec_id, label, v AS u, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS w FROM units, mean_sum),
centred AS (SELECT vec_id, label, u, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM raw_centred)"""


@query("p4_mean_centre", f"WITH {CENTRED} {long_sql('centred', 'vec_id', 'v')}")
def _(t):
    return components(B.centre(t.embeddings), ["vec_id"], "embedding")


@query(
    "p5_reject_below_theta",
    f"WITH {FIVE_SHOT} SELECT vec_id, CASE WHEN score < {THETA} THEN 'Unknown' ELSE best_label::VARCHAR END AS predicted, "
    "round(score, 6) AS score FROM top",
)
def _(t):
    bank, held = five_shot(t)
    return S.classify(held, bank, THETA).select("vec_id", "predicted", F.round("score", 6).alias("score"))


@query(
    "p6_margin_guard",
    f"WITH {FIVE_SHOT} SELECT vec_id, score >= {THETA} AND score - second >= {MARGIN} AS is_known, "
    "round(score - second, 6) AS margin FROM top",
)
def _(t):
    bank, held = five_shot(t)
    return S.classify(held, bank, THETA, MARGIN).select("vec_id", "is_known", F.round("margin", 6).alias("margin"))


@query(
    "p16_vector_audit",
    f"WITH {UNITS}, twin AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 2)) AS t, "
    "CAST(embedding AS DOUBLE[]) AS d FROM embeddings), a AS (SELECT vec_id, len(d) AS dims, "
    "abs(sqrt(list_dot_product(d, d)) - 1) < 1e-5 AS unit, "
    "list_dot_product(d, t) / sqrt(list_dot_product(d, d)) / sqrt(list_dot_product(t, t)) AS c FROM twin) "
    "SELECT vec_id, dims = 64 AND unit AND c >= 0.9985 AS passed, "
    "concat_ws(',', CASE WHEN dims <> 64 THEN 'dimension' END, CASE WHEN NOT unit THEN 'norm' END, "
    "CASE WHEN c < 0.9985 THEN 'variant' END) AS reasons, round(c, 6) AS variant_cosine FROM a",
)
def _(t):
    """A variant rounded to two digits has to stay within cosine 0.9985 of the vector."""
    e = t.embeddings
    twin = e.select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: F.round(x, 2)).alias("embedding"))
    return audit.vector_audit(e, twin, dim=64, least_cosine=0.9985).select(
        "vec_id", "passed", F.concat_ws(",", "reasons").alias("reasons"), F.round("variant_cosine", 6).alias("variant_cosine")
    )


@query("f5_cosine_to_first", f"WITH {UNITS} SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS cosine FROM units a, (SELECT v FROM units ORDER BY vec_id LIMIT 1) b")
def _(t):
    """Cosine of every vector with the one of the smallest id."""
    first = t.embeddings.agg(F.min_by("embedding", "vec_id").alias("first"))
    return t.embeddings.join(F.broadcast(first)).select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine")
    )


@query(
    "f13_f14_sigmoid_argmax",
    "WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, "
    "(list_position(v, list_max(v)) - 1)::BIGINT AS best, round(1 / (1 + exp(-greatest(-20, least(20, 50 * list_max(v))))), 6) AS confidence FROM d",
)
def _(t):
    v = F.col("embedding")
    return t.embeddings.select(
        "vec_id", V.argmax(v).cast("long").alias("best"),
        F.round(V.sigmoid(F.array_max(v).cast("double") * 50), 6).alias("confidence"),
    )


@query(
    "f15_vector_json_round_trip",
    "SELECT vec_id, true AS same, len(embedding)::BIGINT AS n FROM embeddings",
)
def _(t):
    back = V.vec_from_json(V.vec_to_json(V.doubles(F.col("embedding"))))
    return t.embeddings.select(
        "vec_id", (back == V.doubles(F.col("embedding"))).alias("same"), F.size(back).cast("long").alias("n")
    )


@query("f19_score_map", f"WITH {FIVE_SHOT} SELECT vec_id, label::VARCHAR AS label, round(s, 4) AS score FROM scores")
def _(t):
    bank, held = five_shot(t)
    rows = S.candidate_rows(S.score(held, bank, all_scores=True), None, ["vec_id"])
    maps = rows.groupBy("vec_id").agg(V.score_map(F.col("label"), F.col("score")).alias("scores"))
    return maps.select("vec_id", F.explode("scores").alias("label", "score"))


@query(
    "j1_cosine_scores",
    f"WITH {FIVE_SHOT} SELECT vec_id, label, round(s, 6) AS score FROM scores",
)
def _(t):
    bank, held = five_shot(t)
    scored = S.score(held.select("vec_id", "embedding"), bank, all_scores=True)
    return S.candidate_rows(scored, None, ["vec_id"]).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    "j2_multi_prototype",
    f"WITH {RANKED}, " + centroids("bank", "(SELECT *, rn % 2 AS part FROM ranked)", "label, part", "rn <= 6")
    + ", best AS (SELECT q.vec_id, b.label, max(list_dot_product(q.v, b.c)) AS s FROM ranked q, bank b WHERE q.rn > 6 GROUP BY ALL), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS place FROM best) "
    "SELECT vec_id, place AS rank, label, round(s, 6) AS score FROM placed WHERE place <= 3",
)
def _(t):
    """Two sub-prototypes per label from alternating rows of the first six."""
    first = first_rows(t.embeddings, ["label"], [F.col("vec_id")], 6)
    bank = B.fit_bank(first.withColumn("part", F.col("rank") % 2), ["label", "part"])
    _, held = B.enrol_split(t.embeddings, 6)
    return S.candidate_rows(S.score(held, bank, k=3), 3, ["vec_id"]).select(
        "vec_id", "rank", "label", F.round("score", 6).alias("score")
    )


@query(
    "j4_candidate_enrichment",
    f"WITH {FIVE_SHOT} SELECT p.vec_id, p.place AS rank, n.n_name AS name, round(p.s, 6) AS score "
    "FROM placed p LEFT JOIN nation n ON n.n_nationkey = p.label WHERE p.place <= 5",
)
def _(t):
    bank, held = five_shot(t)
    rows = S.candidate_rows(S.score(held, bank, k=5), 5, ["vec_id"])
    return rows.join(t.nation, F.col("label") == F.col("n_nationkey"), "left").select(
        "vec_id", "rank", F.col("n_name").alias("name"), F.round("score", 6).alias("score")
    )


@query("j7_enrolled_only", "SELECT vec_id, label FROM embeddings WHERE label IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2)")
def _(t):
    """Evaluation rows whose label is enrolled (nations of the first three regions)."""
    enrolled = t.nation.filter("n_regionkey <= 2").select(F.col("n_nationkey").alias("label"))
    return t.embeddings.select("vec_id", "label").join(enrolled, "label", "left_semi").select("vec_id", "label")


TWO_BANKS = f"WITH {RANKED}, " + centroids("one", "ranked", where="rn <= 1") + ", " + centroids("five", "ranked", where="rn <= 5") + """,
pa AS (SELECT q.vec_id, q.label AS truth, b.label, list_dot_product(q.v, b.c) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, b.c) DESC, b.label) AS place FROM ranked q, one b WHERE q.rn > 5),
pb AS (SELECT q.vec_id, b.label, list_dot_product(q.v, b.c) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, b.c) DESC, b.label) AS place FROM ranked q, five b WHERE q.rn > 5),
both_sides AS (SELECT pa.vec_id, pa.truth AS label, pa.label AS stock_label, round(pa.s, 6) AS stock_score,
  pb.label AS bank_label, round(pb.s, 6) AS bank_score, pa.label = pa.truth AS stock_correct, pb.label = pa.truth AS bank_correct
  FROM pa JOIN pb USING (vec_id) WHERE pa.place = 1 AND pb.place = 1)"""


def two_banks(t: Tables) -> DataFrame:
    """One-shot (stock) and five-shot bank on the same held-out rows."""
    bank, held = five_shot(t)
    stock = B.fit_bank(first_rows(t.embeddings, ["label"], [F.col("vec_id")], 1))
    return E.compare_predictions(
        S.decide(S.score(held, stock), THETA), S.decide(S.score(held, bank), THETA), held, "vec_id"
    )


@query("j12_compare_predictions", TWO_BANKS + " SELECT * FROM both_sides")
def _(t):
    return two_banks(t)


@query("a1_centroid", f"WITH {UNITS}, " + centroids("bank", "units") + " SELECT label, n AS n_support, i, round(x, 6) AS x FROM (SELECT label, n, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM bank)")
def _(t):
    return components(B.fit_bank(t.embeddings), ["label", "n_support"], "centroid")


@query("a2_incremental_centroid", f"WITH {UNITS}, " + centroids("bank", "units") + " SELECT label, n AS n_support, i, round(x, 6) AS x FROM (SELECT label, n, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM bank)")
def _(t):
    """Fit on the first five rows per label, then merge the rest: equal to one fit over everything."""
    enrolled, rest = B.enrol_split(t.embeddings, 5)
    return components(B.update_bank(B.fit_bank(enrolled), rest), ["label", "n_support"], "centroid")


@query(
    "a3_global_mean",
    "WITH d AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) "
    "SELECT i, round(avg(x), 6) AS x FROM d GROUP BY i",
)
def _(t):
    return components(B.global_mean(t.embeddings), [], "mean")


@query(
    "a4_cosine_variance",
    f"WITH {UNITS}, " + centroids("bank", "units")
    + " SELECT u.label, round(var_pop(list_dot_product(u.v, b.c)), 6) AS cosine_variance, count(*) AS n FROM units u JOIN bank b USING (label) GROUP BY u.label",
)
def _(t):
    return B.label_spread(t.embeddings).withColumn("cosine_variance", F.round("cosine_variance", 6))


@query(
    "a5_cohesion",
    f"WITH {UNITS}, " + centroids("bank", "units")
    + " SELECT u.label, round(avg(list_dot_product(u.v, b.c)), 4) AS cohesion, count(*) AS n_samples FROM units u JOIN bank b USING (label) GROUP BY u.label",
)
def _(t):
    from vecmeadow.operators.novelty import cohesion

    return cohesion(t.embeddings, "label")


REPORT = """SELECT label, is_total, n, top1_correct, top3_correct, round(a1, 6) AS top1_accuracy, round(a3, 6) AS top3_accuracy,
  round(own, 6) AS mean_true_score, round(gap, 6) AS mean_margin FROM (
  SELECT truth AS label, grouping(truth) = 1 AS is_total, count(*) AS n, sum(top1::INT)::BIGINT AS top1_correct,
    sum(top3::INT)::BIGINT AS top3_correct, avg(top1::INT) AS a1, avg(top3::INT) AS a3, avg(true_score) AS own,
    avg(true_score - rival_score) AS gap FROM top GROUP BY ROLLUP (truth))"""


@query("a8_label_report", f"WITH {FIVE_SHOT} {REPORT}")
def _(t):
    return E.label_report(scored_five_shot(t))


@query(
    "a9_outcome_tally",
    f"WITH {FIVE_SHOT}, g AS (SELECT i / 50.0::DOUBLE AS theta FROM range(51) r(i)), c AS (SELECT theta, "
    "sum((score >= theta AND best_label = truth)::INT)::BIGINT AS correct, sum((score >= theta AND best_label <> truth)::INT)::BIGINT AS wrong, "
    "sum((score < theta)::INT)::BIGINT AS unknown FROM top, g GROUP BY theta) "
    "SELECT *, round(CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) ELSE 0 END, 6) AS precision FROM c",
)
def _(t):
    return E.outcome_tally(scored_five_shot(t, 2), SWEEP)


@query(
    "a10_acceptance_sweep",
    f"WITH {FIVE_SHOT}, g AS (SELECT i / 50.0::DOUBLE AS theta FROM range(51) r(i)) SELECT theta, "
    "sum((score >= theta AND best_label = truth AND score - second >= 0.01)::INT)::BIGINT AS accepted, count(*) AS n, "
    "round(avg((score >= theta AND best_label = truth AND score - second >= 0.01)::INT), 6) AS acceptance FROM top, g GROUP BY theta",
)
def _(t):
    return E.acceptance_sweep(scored_five_shot(t, 2), SWEEP)


@query(
    "a11_confusions",
    f"WITH {FIVE_SHOT} SELECT truth, best_label AS predicted, count(*) AS n, "
    "round(100.0 * count(*) / (SELECT count(*) FROM top), 4) AS percent FROM top WHERE truth <> best_label GROUP BY ALL "
    "ORDER BY n DESC, truth, predicted LIMIT 8",
)
def _(t):
    return E.confusions(scored_five_shot(t, 1))


@query(
    "a11_confusion_matrix",
    f"WITH {FIVE_SHOT} SELECT truth, " + ", ".join(f"sum((best_label = {i})::INT)::BIGINT AS p{i}" for i in range(10)) + " FROM top GROUP BY truth",
)
def _(t):
    labels = [r[0] for r in t.embeddings.select("label").where("label is not null").distinct().orderBy("label").collect()]
    return E.confusion_matrix(scored_five_shot(t, 1), labels)


OPEN_SET = RANKED + """,
names AS (SELECT label, row_number() OVER (ORDER BY label) AS place FROM (SELECT DISTINCT label FROM embeddings)),
inside AS (SELECT label FROM names WHERE place <= greatest(2, (SELECT count(*) FROM names) // 2)),
""" + centroids("bank", "ranked", where="rn <= 5 AND label IN (FROM inside)") + """,
best AS (SELECT q.vec_id, any_value(q.label IN (FROM inside)) AS genuine, max(list_dot_product(q.v, b.c)) AS s
  FROM ranked q, bank b WHERE q.rn > 5 OR q.label NOT IN (FROM inside) GROUP BY q.vec_id)"""

ROC = OPEN_SET + """,
g AS (SELECT i / 50.0::DOUBLE AS theta FROM range(51) r(i)),
curve AS (SELECT round(theta, 4) AS theta,
  round(avg((s >= theta)::INT) FILTER (WHERE NOT genuine), 4) AS far,
  round(avg((s >= theta)::INT) FILTER (WHERE genuine), 4) AS tar FROM best, g GROUP BY theta)"""


def open_set(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Scores of genuine and intruder queries against the bank of the first half of the labels."""
    inside, outside = E.open_set_split(t.embeddings)
    enrolled, held = B.enrol_split(inside, 5)
    bank = checkpointed(B.fit_bank(enrolled))  # both sides meet the same rows
    keep = ["vec_id", "label", "embedding"]
    return S.score(held.select(*keep), bank, k=1), S.score(outside.select(*keep), bank, k=1)


@query("a12_roc_sweep", f"WITH {ROC} SELECT * FROM curve")
def _(t):
    return E.roc(*open_set(t), SWEEP)


@query(
    "a13_equal_error_rate",
    f"WITH {ROC} SELECT theta, round((far + 1 - tar) / 2, 6) AS eer FROM curve ORDER BY round(abs(far - (1 - tar)), 9), theta LIMIT 1",
)
def _(t):
    return E.eer(E.roc(*open_set(t), SWEEP))


@query(
    "a14_auroc",
    f"WITH {OPEN_SET}, r AS (SELECT genuine, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM best), "
    "a AS (SELECT sum(k) FILTER (WHERE genuine) AS rs, count(*) FILTER (WHERE genuine) AS p, count(*) FILTER (WHERE NOT genuine) AS q FROM r) "
    "SELECT round((rs - p * (p + 1) / 2.0) / (p::DOUBLE * q), 6)::DOUBLE AS auroc, p AS positives, q AS negatives FROM a",
)
def _(t):
    genuine, intruder = open_set(t)
    best = F.get("candidates", F.lit(0))["score"].alias("score")
    rows = genuine.select(best, F.lit(True).alias("positive")).unionByName(intruder.select(best, F.lit(False).alias("positive")))
    return E.auroc(rows)


@query(
    "a15_separability",
    f"WITH {UNITS}, p AS (SELECT a.label = b.label AS inner_pair, list_dot_product(a.v, b.v) AS c FROM units a, units b WHERE a.vec_id <> b.vec_id), "
    "m AS (SELECT avg(c) FILTER (WHERE inner_pair) AS i, avg(c) FILTER (WHERE NOT inner_pair) AS o FROM p) "
    "SELECT round(i, 6) AS intra_cosine, round(o, 6) AS inter_cosine, round(i / o, 4) AS separability FROM m",
)
def _(t):
    return E.separability(t.embeddings)


def shuffled_sql(salt: str) -> str:
    return f"('0x' || substr(md5({salt} || ':' || vec_id), 1, 12))::BIGINT"


FEW_SHOT = (
    f"WITH {UNITS}, sized AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM units), "
    f"r AS (SELECT s.*, fold, row_number() OVER (PARTITION BY fold, label ORDER BY {shuffled_sql('fold')}, vec_id) AS rn "
    "FROM sized s, range(3) f(fold) WHERE n >= 6), "
    "g AS (SELECT r.*, k FROM r, (VALUES (5), (10)) ks(k) WHERE n > k), "
    + centroids("bank", "g", "k, fold, label", "rn <= k")
    + ", p AS (SELECT q.k, q.fold, q.label AS truth, b.label, row_number() OVER (PARTITION BY q.k, q.fold, q.vec_id "
    "ORDER BY list_dot_product(q.v, b.c) DESC, b.label) AS place FROM g q JOIN bank b ON b.k = q.k AND b.fold = q.fold "
    "WHERE q.rn > q.k AND q.rn <= q.k + greatest(1, (q.n - q.k) // 3)) "
    "SELECT k::INTEGER AS k_shots, fold::INTEGER AS fold, round(avg((label = truth)::INT), 4) AS top1_accuracy, count(*) AS n_queries FROM p WHERE place = 1 GROUP BY k, fold"
)


@query("a16_few_shot", FEW_SHOT)
def _(t):
    return E.few_shot(t.embeddings, [5, 10], 3)


CROSS = (
    f"WITH {UNITS}, r AS (SELECT *, (label % 4)::INTEGER AS grp, row_number() OVER (PARTITION BY label ORDER BY {shuffled_sql('0')}, vec_id) AS rn FROM units), "
    + centroids("bank", "r", "grp, label", "rn <= 5")
    + ", p AS (SELECT q.grp, q.label AS truth, b.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, b.c) DESC, b.label) AS place "
    "FROM r q JOIN bank b USING (grp) WHERE q.rn > 5), s AS (SELECT grp, count(DISTINCT label) AS n_labels FROM r GROUP BY grp) "
    'SELECT grp AS "group", 5::INTEGER AS k_shots, round(avg((label = truth)::INT), 4) AS top1_accuracy, any_value(n_labels) AS n_labels, count(*) AS n_queries '
    "FROM p JOIN s USING (grp) WHERE place = 1 AND n_labels >= 2 GROUP BY grp"
)


@query("a17_cross_group", CROSS)
def _(t):
    return E.cross_group(t.embeddings, (F.col("label") % 4).cast("int"))


LATENCY = """SELECT event_type AS model, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, round(min(value), 2) AS min,
  round(max(value), 2) AS max, count(value) AS n FROM events GROUP BY event_type"""


@query(
    "a18_run_summary",
    TWO_BANKS + f", lat AS ({LATENCY}), few AS (SELECT event_type AS model, 5 AS k_shots, value AS top1_accuracy FROM events) "
    "SELECT model || '_K' || k_shots || '_mean_acc' AS key, round(avg(top1_accuracy), 4) AS value FROM few GROUP BY model, k_shots "
    "UNION ALL SELECT model || '_latency_mean_ms', mean FROM lat "
    "UNION ALL SELECT 'stock_accuracy', round(avg(stock_correct::INT), 4) FROM both_sides "
    "UNION ALL SELECT 'bank_accuracy', round(avg(bank_correct::INT), 4) FROM both_sides",
)
def _(t):
    """Event values stand in for the per-fold accuracies and latencies of each model."""
    few = t.events.select(F.col("event_type").alias("model"), F.lit(5).alias("k_shots"), F.col("value").alias("top1_accuracy"))
    latency = E.sample_statistics(t.events.withColumnRenamed("event_type", "model"), "value", ["model"])
    return E.run_summary(few, latency, two_banks(t))


@query("a19_sample_statistics", LATENCY)
def _(t):
    return E.sample_statistics(t.events.withColumnRenamed("event_type", "model"), "value", ["model"])


@query(
    "a24_headline",
    f"WITH {FIVE_SHOT}, s AS (SELECT vec_id, truth AS recording, CASE WHEN score >= {THETA} AND score - second >= {MARGIN} THEN best_label::VARCHAR ELSE 'Unknown' END AS predicted, "
    f"score, score >= {THETA} AND score - second >= {MARGIN} AS is_known FROM top) "
    "SELECT recording, vec_id AS segment, predicted, round(score, 6) AS score, is_known FROM s "
    "QUALIFY row_number() OVER (PARTITION BY recording ORDER BY is_known DESC, score DESC, vec_id) = 1",
)
def _(t):
    """Each label plays one uploaded recording, its rows the segments."""
    bank, held = five_shot(t)
    d = S.classify(held, bank, THETA, MARGIN).withColumnsRenamed({"vec_id": "segment", "label": "recording"})
    return S.headline(d, "recording").withColumn("score", F.round("score", 6))


RECALL = f"""r AS (SELECT n.n_nationkey AS label, rec AS recall, sim AS similarity, coalesce(cnt, 0) AS n FROM nation n LEFT JOIN (
  SELECT truth, round(100.0 * avg((score >= {THETA} AND best_label = truth)::INT), 4) AS rec, round(avg(true_score), 6) AS sim, count(*) AS cnt
  FROM top GROUP BY truth) m ON m.truth = n.n_nationkey)"""


def recall(t: Tables) -> DataFrame:
    labels = t.nation.select(F.col("n_nationkey").alias("label"))
    return E.recall_report(scored_five_shot(t, 2), labels, THETA)


@query("a27_recall_report", f"WITH {FIVE_SHOT}, {RECALL} SELECT * FROM r")
def _(t):
    """Labels are the nations; those without queries keep null measures."""
    return recall(t)


@query(
    "a28_diagnosis",
    f"WITH {FIVE_SHOT}, {RECALL} SELECT r.label, CASE WHEN recall IS NULL THEN 'not measured' WHEN recall >= 80 THEN 'compact prototype' "
    "WHEN recall >= 50 THEN 'distinct, moderate variance' WHEN similarity >= 0.7 THEN 'close to the threshold' "
    "WHEN taxon = 'aves' AND n >= 20 THEN 'wide repertoire' WHEN taxon = 'aves' THEN 'needs more examples' "
    "WHEN taxon = 'insecta' THEN 'high-frequency signal' WHEN taxon = 'amphibia' THEN 'low-frequency pulses' "
    "WHEN taxon = 'mammalia' THEN 'short transients' ELSE 'needs denser examples' END AS reason FROM (SELECT r.*, "
    "['aves', 'insecta', 'amphibia', 'mammalia', 'other'][n_regionkey + 1] AS taxon FROM r JOIN nation ON n_nationkey = r.label) r",
)
def _(t):
    """The region of a nation stands in for the taxon."""
    names = F.array(*[F.lit(x) for x in ("aves", "insecta", "amphibia", "mammalia", "other")])
    taxa = t.nation.select(F.col("n_nationkey").alias("label"), F.get(names, F.col("n_regionkey")).alias("taxon"))
    return recall(t).join(taxa, "label").select(
        "label", E.diagnosis(F.col("recall"), F.col("similarity"), F.col("taxon"), F.col("n")).alias("reason")
    )


@query(
    "l3_ranked_report",
    f"WITH {FIVE_SHOT}, {RECALL} SELECT row_number() OVER (ORDER BY recall DESC NULLS LAST, similarity DESC NULLS LAST, n DESC, label) AS rank, * FROM r",
)
def _(t):
    return E.ranked_report(recall(t))


@query(
    "a29_pair_statistics",
    f"WITH {UNITS}, p AS (SELECT list_dot_product(a.v, b.v) AS c FROM units a JOIN units b ON a.vec_id < b.vec_id) "
    "SELECT count(*) AS pairs, round(min(c), 6) AS min_cosine, round(max(c), 6) AS max_cosine, round(avg(c), 6) AS mean_cosine, round(stddev_pop(c), 6) AS std_cosine FROM p",
)
def _(t):
    return E.pair_statistics(t.embeddings)


@query("w1_top_candidates", f"WITH {FIVE_SHOT} SELECT vec_id, place AS rank, label, round(s, 6) AS score FROM placed WHERE place <= 5")
def _(t):
    bank, held = five_shot(t)
    return S.candidate_rows(S.score(held, bank, k=5), 5, ["vec_id"]).withColumn("score", F.round("score", 6))


@query("w2_top_margin", f"WITH {FIVE_SHOT} SELECT vec_id, best_label, round(score - second, 6) AS margin FROM top")
def _(t):
    return S.decide(scored_five_shot(t, 2), 0.0).select("vec_id", "best_label", F.round("margin", 6).alias("margin"))


@query(
    "w3_rival_margin",
    f"WITH {FIVE_SHOT} SELECT vec_id, round(true_score, 6) AS true_score, round(rival_score, 6) AS rival_score, round(true_score - rival_score, 6) AS margin FROM top",
)
def _(t):
    r = lambda c: F.round(c, 6)
    return scored_five_shot(t).select(
        "vec_id", r("true_score").alias("true_score"), r("rival_score").alias("rival_score"),
        r(F.col("true_score") - F.col("rival_score")).alias("margin"),
    )


@query(
    "w11_positional_split",
    f"WITH {RANKED} SELECT vec_id, label, CASE WHEN rn <= 3 THEN 'enrol' WHEN rn <= 8 THEN 'test' WHEN rn <= 30 THEN 'extra' ELSE 'rest' END AS part FROM ranked",
)
def _(t):
    from vecmeadow.operators.ordered import numbered

    r = numbered(t.embeddings.select("vec_id", "label"), ["label"], "vec_id", "vec_id", "rn")
    part = F.when(F.col("rn") <= 3, "enrol").when(F.col("rn") <= 8, "test").when(F.col("rn") <= 30, "extra").otherwise("rest")
    return r.select("vec_id", "label", part.alias("part"))


@query("m1_fit_bank", f"WITH {RANKED}, " + centroids("bank", "ranked", where="rn <= 5") + " SELECT label, n AS n_support, round(sqrt(list_dot_product(s, s)), 6) AS sum_length, round(c[1], 6) AS first_entry FROM bank JOIN bank_sum USING (label, n)")
def _(t):
    bank, _ = five_shot(t)
    return bank.select(
        "label", "n_support", F.round(V.norm(F.col("sum_vector")), 6).alias("sum_length"), F.round(F.col("centroid")[0], 6).alias("first_entry")
    )


@query(
    "m2_classify",
    f"WITH {FIVE_SHOT} SELECT vec_id, truth AS label, best_label, round(score, 6) AS score, round(score - second, 6) AS margin, "
    f"score >= {THETA} AND score - second >= {MARGIN} AS is_known, CASE WHEN score >= {THETA} AND score - second >= {MARGIN} "
    "THEN best_label::VARCHAR ELSE 'Unknown' END AS predicted FROM top",
)
def _(t):
    bank, held = five_shot(t)
    d = S.classify(held, bank, THETA, MARGIN)
    return d.select(
        "vec_id", "label", "best_label", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "is_known", "predicted"
    )


@query(
    "m2_classify_centred",
    f"WITH {RANKED}, " + centroids("bank", "ranked", where="rn <= 5") + """,
gm AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(c) AS x, generate_subscripts(c, 1) AS i FROM bank) GROUP BY i)),
bw AS (SELECT label, list_transform(list_zip(c, m), lambda z: z[1] - z[2]) AS w FROM bank, gm),
bc AS (SELECT label, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS c FROM bw),
qw AS (SELECT vec_id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS w FROM ranked, gm WHERE rn > 5),
qc AS (SELECT vec_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM qw)
SELECT vec_id, b.label AS best_label, round(list_dot_product(v, c), 6) AS score FROM qc, bc b
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, c) DESC, b.label) = 1""",
)
def _(t):
    bank, held = five_shot(t)
    return S.classify(held, bank, THETA, centring=True).select("vec_id", "best_label", F.round("score", 6).alias("score"))


@query(
    "m3_bank_maintenance",
    f"WITH {RANKED}, " + centroids("bank", "ranked", where="rn <= 5") + " SELECT label, round(c[1], 6) AS first_entry FROM bank WHERE label NOT IN (3, 7) ORDER BY label",
)
def _(t):
    """Remove two labels, then list the rest with their prototypes."""
    bank, _ = five_shot(t)
    left = B.remove_labels(bank, [3, 7])
    return B.list_labels(left).join(left, "label").select("label", F.round(F.col("centroid")[0], 6).alias("first_entry"))


@query(
    "m8_rejection_rate",
    f"WITH {OPEN_SET}, g AS (SELECT i / 50.0::DOUBLE AS theta FROM range(51) r(i)) SELECT theta, count(*) AS n, sum((s < theta)::INT)::BIGINT AS rejected, "
    "round(avg((s < theta)::INT), 6) AS rejection_rate FROM best, g WHERE NOT genuine GROUP BY theta",
)
def _(t):
    return E.rejection_rate(open_set(t)[1], SWEEP)


@query(
    "m10_closed_set",
    f"WITH {FIVE_SHOT}, c AS (SELECT vec_id, best_label = truth AS hit, 1 / (1 + exp(-greatest(-20, least(20, score)))) AS conf FROM top), "
    "g AS (SELECT unnest([0.5, 0.525, 0.55, 0.575, 0.6]::DOUBLE[]) AS cut) SELECT cut, sum((conf >= cut AND hit)::INT)::BIGINT AS correct, "
    "sum((conf >= cut AND NOT hit)::INT)::BIGINT AS wrong, sum((conf < cut)::INT)::BIGINT AS none FROM c, g GROUP BY cut",
)
def _(t):
    """Cosines serve as the logits of the bank's classes."""
    bank, held = five_shot(t)
    scored = S.score(held, bank, all_scores=True)
    by_class = F.transform(F.array_sort("candidates"), lambda c: c["score"])
    names = [r[0] for r in bank.select("label").orderBy("label").collect()]
    return E.closed_set(scored, by_class, names, CUTS)


@query(
    "x6_centroid_aggregate",
    f"WITH {UNITS}, " + centroids("bank", "units") + f" {long_sql('bank', 'label', 'c')}",
)
def _(t):
    """The aggregate expression that users put into ``groupBy().agg()``."""
    return components(t.embeddings.groupBy("label").agg(V.centroid(F.col("embedding")).alias("c")), ["label"], "c")
