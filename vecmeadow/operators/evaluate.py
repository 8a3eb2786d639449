"""Accuracy, rejection and separability measures over scored queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmeadow.functions import vectors as V
from vecmeadow.functions.arrow import list_column, matrix_of
from vecmeadow.operators.balls import Cover
from vecmeadow.operators.bank import fit_bank
from vecmeadow.operators.ordered import ROWS_PER_TASK, arrange, numbered, ranked_globally, total
from vecmeadow.operators.scoring import decide, score
from vecmeadow.operators.tiles import ROWS_PER_BLOCK
from vecmeadow.session import checkpointed


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def top_place(truth: str = "label", k: int = 3) -> Column:
    """True when the true label is among the first ``k`` candidates."""
    return F.exists(F.slice("candidates", 1, k), lambda c: c["label"] == F.col(truth))


def label_report(scored: DataFrame, truth: str = "label") -> DataFrame:
    """Per-label and overall top-1, top-3, mean true score and mean margin over the best rival.

    ``scored`` comes from ``score(..., k>=3, truth=truth)``. The overall row has a
    null label and ``is_total`` set.
    """
    rows = scored.select(
        F.col(truth).alias("label"),
        top_place(truth, 1).cast("long").alias("top1"),
        top_place(truth, 3).cast("long").alias("top3"),
        F.coalesce("true_score", F.lit(0.0)).alias("own"),
        (F.coalesce("true_score", F.lit(0.0)) - F.col("rival_score")).alias("gap"),
    )
    return rows.rollup("label").agg(
        F.grouping("label").cast("boolean").alias("is_total"),
        F.count(F.lit(1)).alias("n"),
        F.sum("top1").alias("top1_correct"),
        F.sum("top3").alias("top3_correct"),
        F.round(F.avg("top1"), 6).alias("top1_accuracy"),
        F.round(F.avg("top3"), 6).alias("top3_accuracy"),
        F.round(F.avg("own"), 6).alias("mean_true_score"),
        F.round(F.avg("gap"), 6).alias("mean_margin"),
    )


def swept(df: DataFrame, value: str, thetas: list[float], counts: dict[str, Column]) -> DataFrame:
    """For every theta, each count restricted to rows with ``value >= theta``, plus its total.

    One pass: rows fall into ``len(thetas) + 1`` buckets that are counted map-side,
    and the thetas meet only those bucket counts, never the rows.
    """
    ordered = sorted(thetas)
    points = F.array(*[F.lit(float(t)) for t in ordered])
    reached = F.size(F.filter(points, lambda t: t <= F.col(value)))
    buckets = (
        df.groupBy(F.coalesce(reached, F.lit(0)).alias("__reached"))
        .agg(*[F.sum(c.cast("long")).alias(name) for name, c in counts.items()])
    )
    at = F.explode(F.transform(points, lambda t, i: F.struct(i.alias("i"), t.alias("theta"))))
    per_theta = buckets.withColumn("__t", at).groupBy(F.col("__t.theta").alias("theta"))
    inside = F.col("__t.i") < F.col("__reached")
    return per_theta.agg(
        *[F.sum(F.when(inside, F.col(name)).otherwise(0)).alias(name) for name in counts],
        *[F.sum(name).alias(f"{name}_total") for name in counts],
    )


def outcome_tally(scored: DataFrame, thetas: list[float], truth: str = "label") -> DataFrame:
    """Correct, wrong, unknown and precision at each theta (precision 0 when nothing is accepted)."""
    best = F.get("candidates", F.lit(0))
    rows = scored.select(best["score"].alias("s"), (best["label"] == F.col(truth)).cast("long").alias("hit"))
    swept_rows = swept(rows, "s", thetas, {"correct": F.col("hit"), "wrong": 1 - F.col("hit")})
    accepted = F.col("correct") + F.col("wrong")
    total = F.col("correct_total") + F.col("wrong_total")
    return swept_rows.select(
        "theta", "correct", "wrong", (total - accepted).alias("unknown"),
        F.round(share(F.col("correct"), accepted), 6).alias("precision"),
    )


def acceptance_sweep(scored: DataFrame, thetas: list[float], margin: float = 0.01, truth: str = "label") -> DataFrame:
    """Share of queries accepted with the right label: top-1 right, ``score >= theta`` and ``margin`` kept."""
    d = decide(scored, 0.0)
    right = (F.col("best_label") == F.col(truth)) & (F.col("margin") >= margin)
    rows = d.select("score", right.cast("long").alias("ok"))
    return swept(rows, "score", thetas, {"accepted": F.col("ok"), "n": F.lit(1)}).select(
        "theta", "accepted", F.col("n_total").alias("n"),
        F.round(F.col("accepted") / F.col("n_total"), 6).alias("acceptance"),
    )


def confusions(scored: DataFrame, n: int = 8, truth: str = "label") -> DataFrame:
    """The ``n`` most frequent wrong (true, predicted) pairs with their share of all queries."""
    pairs = confusion_counts(scored, truth)
    total = pairs.agg(F.sum("n").alias("__all"))
    wrong = pairs.filter(F.col("truth") != F.col("predicted"))
    ranked = wrong.orderBy(F.desc("n"), "truth", "predicted").limit(n)
    return ranked.join(F.broadcast(total)).select(
        "truth", "predicted", "n", F.round(100.0 * F.col("n") / F.col("__all"), 4).alias("percent")
    )


def confusion_counts(scored: DataFrame, truth: str = "label") -> DataFrame:
    best = F.get("candidates", F.lit(0))["label"]
    return scored.groupBy(F.col(truth).alias("truth"), best.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(scored: DataFrame, labels: list, truth: str = "label") -> DataFrame:
    """One column per label (``labels`` fixes the columns, so no job is run to find them)."""
    pairs = confusion_counts(scored, truth)
    wide = pairs.groupBy("truth").pivot("predicted", labels).agg(F.sum("n"))
    return wide.select("truth", *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"p{v}") for v in labels])


def roc(genuine: DataFrame, intruder: DataFrame, thetas: list[float]) -> DataFrame:
    """TAR and FAR per theta over the best scores of genuine and intruder queries."""
    best = F.get("candidates", F.lit(0))["score"]
    rows = genuine.select(best.alias("s"), F.lit(1).alias("g")).unionByName(
        intruder.select(best.alias("s"), F.lit(0).alias("g"))
    )
    found = swept(rows, "s", thetas, {"g": F.col("g"), "i": 1 - F.col("g")})
    return found.select(
        F.round("theta", 4).alias("theta"),
        F.round(share(F.col("i"), F.col("i_total")), 4).alias("far"),
        F.round(share(F.col("g"), F.col("g_total")), 4).alias("tar"),
    )


def eer(curve: DataFrame) -> DataFrame:
    """The first theta with the smallest ``|FAR - FRR|`` and the mean of both there."""
    frr = 1.0 - F.col("tar")
    rows = curve.select("theta", F.abs(F.col("far") - frr).alias("gap"), ((F.col("far") + frr) / 2.0).alias("eer"))
    # The gap is compared at 9 digits so that equal gaps do not differ by rounding noise.
    best = F.min_by(F.struct("theta", "eer"), F.struct(F.round("gap", 9).alias("g"), F.col("theta").alias("t")))
    return rows.agg(best.alias("b")).select(F.col("b.theta").alias("theta"), F.round("b.eer", 6).alias("eer"))


def open_set_split(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows of the first half of the labels (at least two), and rows of all other labels."""
    names = df.select(label).distinct()
    ranked = ranked_globally(names, [F.col(label)], "__place")
    half = ranked.count()
    enrolled = ranked.filter(F.col("__place") <= max(2, half // 2)).select(label)
    return df.join(enrolled, label, "left_semi"), df.join(enrolled, label, "left_anti")


def auroc(scores: DataFrame, value: str = "score", positive: str = "positive", limit: int = ROWS_PER_TASK) -> DataFrame:
    """Rank-sum area under the ROC curve, equal scores counting half.

    Equal scores are merged first; the running count of negatives is cut into
    chunks like any other hot ordered group.
    """
    flag = F.col(positive).cast("long")
    per_score = scores.groupBy(F.col(value).alias("s")).agg(
        F.sum(flag).alias("p"), F.sum(1 - flag).alias("q")
    )
    ordered = arrange(per_score.withColumn("__all", F.lit(0)), ["__all"], "s", "s", limit)
    ordered = ordered.columns(below=total(F.col("q")))
    wins = F.col("p") * (F.col("below") - F.col("q") + 0.5 * F.col("q"))
    return ordered.df.agg(
        F.round(F.sum(wins) / (F.sum("p").cast("double") * F.sum("q")), 6).alias("auroc"),
        F.sum("p").alias("positives"),
        F.sum("q").alias("negatives"),
    )


def separability(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean cosine inside labels over mean cosine across labels, from the label sums alone.

    For unit vectors the cosines of all ordered pairs of a set add up to
    ``|sum|^2``, so no pair is ever formed.
    """
    bank = fit_bank(df, label, vector)
    per_label = bank.agg(
        V.vector_sum(F.col("sum_vector")).alias("all_sum"),
        F.sum(V.dot(F.col("sum_vector"), F.col("sum_vector"))).alias("inner"),
        F.sum("n_support").alias("n"),
        F.sum(F.col("n_support") * (F.col("n_support") - 1)).alias("inner_pairs"),
    )
    intra = (F.col("inner") - F.col("n")) / F.col("inner_pairs")
    outer_pairs = F.col("n") * (F.col("n") - 1) - F.col("inner_pairs")
    inter = (V.dot(F.col("all_sum"), F.col("all_sum")) - F.col("inner")) / outer_pairs
    return per_label.select(
        F.round(intra, 6).alias("intra_cosine"), F.round(inter, 6).alias("inter_cosine"),
        F.round(intra / inter, 4).alias("separability"),
    )


def _gram_square(nodes: DataFrame, width: int) -> float:
    """Squares of all entries of the weighted matrix of inner products of columns, summed: row ``i`` of it is one group."""

    def part(batches):
        gram = np.zeros((width, width))
        for batch in batches:
            v = matrix_of(batch.column(0), width)
            gram += (v * batch.column(1).to_numpy()[:, None]).T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), list_column(gram)], names=["i", "entries"])

    rows = nodes.select("v", "weight").mapInArrow(part, "i int, entries array<double>")
    rows = rows.groupBy("i").agg(V.vector_sum(F.col("entries")).alias("entries"))
    return rows.agg(F.sum(V.dot(F.col("entries"), F.col("entries")))).first()[0]


def _extreme_cosines(nodes: DataFrame, rows_per_block: int) -> tuple[float | None, float | None]:
    """Least and greatest cosine between different nodes: the pivots' own bound both, then only balls that can do better are met."""
    cover = Cover(nodes.select("node", "v"), "node", rows_per_block)
    if cover.count < 2:
        return None, None
    pivots, ids = cover.pivots, cover.pivot_ids

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                found = matrix_of(some.column(1)) @ pivots.T
                found = found[some.column(0).to_numpy()[:, None] != ids[None, :]]
                if found.size:
                    yield pa.RecordBatch.from_pydict({"lo": [found.min()], "hi": [found.max()]})

    def greatest(sign: float):
        def best(one, two, same):
            left, right = matrix_of(one.column("v")), matrix_of(two.column("v"))
            for at in range(0, len(left), 1024):
                found = sign * (left[at : at + 1024] @ right.T)
                if same:
                    found = found[np.arange(at, at + len(found))[:, None] < np.arange(len(right))[None, :]]
                if found.size:
                    yield pa.table({"best": [found.max()]})

        return best

    schema = T.StructType([T.StructField("best", T.DoubleType())])
    low, high = cover.rows.select("node", "v").mapInArrow(probe, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()
    near, far = cover.reach(high), cover.reach(-low, opposite=True)
    higher = cover.tiles(cover.rows, near, cover.parts(near), greatest(1.0), schema).agg(F.max("best")).first()[0]
    lower = cover.tiles(cover.rows, far, cover.parts(far), greatest(-1.0), schema).agg(F.max("best")).first()[0]
    return min(low, low if lower is None else -lower), max(high, high if higher is None else higher)


def pair_statistics(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Minimum, maximum, mean and population deviation of the cosine over all unordered pairs.

    Mean and deviation come from the sum of the unit vectors and their D x D matrix of inner products, with no
    pair formed; only the extremes are searched. Fewer than two rows give 0 pairs and nulls.
    """
    grouped = df.groupBy(vector).agg(F.min(id_col).alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = checkpointed(grouped.select("node", "weight", V.l2(F.col(vector)).alias("v")))
    weighted = F.transform("v", lambda x: x * F.col("weight"))
    rows, most, width = nodes.agg(F.sum("weight"), F.max("weight"), F.max(F.size("v"))).first()
    values = [None] * 4
    pairs = (rows or 0) * ((rows or 0) - 1) // 2
    if pairs:
        low, high = _extreme_cosines(nodes, rows_per_block)
        whole = nodes.agg(V.norm(V.vector_sum(weighted))).first()[0]
        mean = (whole * whole - rows) / (2 * pairs)
        square = (_gram_square(nodes, width) - rows) / (2 * pairs)
        values = [1.0 if low is None else low, 1.0 if most > 1 else high, mean, max(0.0, square - mean * mean) ** 0.5]
    names = ("min_cosine", "max_cosine", "mean_cosine", "std_cosine")
    shown = [F.round(F.lit(x).cast("double"), 6).alias(name) for x, name in zip(values, names)]
    return df.sparkSession.range(1).select(F.lit(pairs).cast("long").alias("pairs"), *shown)


def shuffled_number(salt: Column, id_col: str) -> Column:
    """A fixed pseudo-random order key that any SQL engine can recompute."""
    text = F.concat_ws(":", salt.cast("string"), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def few_shot(
    df: DataFrame, shots: list[int], folds: int, label: str = "label", id_col: str = "vec_id",
    vector: str = "embedding", least: int = 6, limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Top-1 accuracy for every (shots, fold), support and queries being disjoint.

    Only ids are shuffled into folds; vectors are joined to the rows that take
    part. All folds are fitted by one grouped aggregate and scored in one pass.
    """
    ids = df.select(label, id_col)
    sizes = ids.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    spread = ids.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    spread = spread.withColumn("__o", shuffled_number(F.col("fold"), id_col))
    ranked = numbered(spread, ["fold", label], "__o", id_col, "__rank", limit).join(sizes, label)
    ranked = ranked.withColumn("k_shots", F.explode(F.array(*[F.lit(k) for k in shots])))
    eligible = sizes.withColumn("k_shots", F.explode(F.array(*[F.lit(k) for k in shots]))).filter("__n > k_shots")
    usable = eligible.groupBy("k_shots").agg(F.count(F.lit(1)).alias("__labels")).filter("__labels >= 2")
    width = F.greatest(F.lit(1), F.floor((F.col("__n") - F.col("k_shots")) / folds))
    ranked = ranked.filter("__n > k_shots").filter(F.col("__rank") <= F.col("k_shots") + width)
    ranked = ranked.join(F.broadcast(usable.select("k_shots")), "k_shots", "left_semi")
    cell = (F.col("k_shots") * 100_000 + F.col("fold")).cast("long")
    rows = ranked.withColumn("cell", cell).select("cell", "k_shots", "fold", "__rank", id_col).join(df, id_col)
    support = rows.filter(F.col("__rank") <= F.col("k_shots"))
    queries = rows.filter(F.col("__rank") > F.col("k_shots"))
    bank = fit_bank(support, ["cell", label], vector)
    scored = score(queries.select("cell", "k_shots", "fold", label, id_col, vector), bank, k=1, vector=vector, label=label, group="cell")
    hit = (F.get("candidates", F.lit(0))["label"] == F.col(label)).cast("int")
    return scored.groupBy("k_shots", "fold").agg(
        F.round(F.avg(hit), 4).alias("top1_accuracy"), F.count(F.lit(1)).alias("n_queries")
    )


def cross_group(
    df: DataFrame, group: Column, k: int = 5, label: str = "label", id_col: str = "vec_id",
    vector: str = "embedding", least: int = 6, limit: int = ROWS_PER_TASK,
) -> DataFrame:
    """Top-1 accuracy inside each group of labels: labels compete only within their group."""
    grouped = df.withColumn("group", group)
    sizes = grouped.groupBy("group", label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    wide = sizes.groupBy("group").agg(F.count(F.lit(1)).alias("n_labels")).filter("n_labels >= 2")
    ids = grouped.select("group", label, id_col).join(sizes.select("group", label), ["group", label], "left_semi")
    ids = ids.join(wide.select("group"), "group", "left_semi").withColumn("__o", shuffled_number(F.lit(0), id_col))
    ranked = numbered(ids, [label], "__o", id_col, "__rank", limit).select(id_col, "group", "__rank")
    rows = ranked.join(df, id_col)
    bank = fit_bank(rows.filter(F.col("__rank") <= k), ["group", label], vector)
    scored = score(rows.filter(F.col("__rank") > k).select("group", label, vector), bank, k=1, vector=vector, label=label, group="group")
    hit = (F.get("candidates", F.lit(0))["label"] == F.col(label)).cast("int")
    return scored.groupBy("group").agg(
        F.round(F.avg(hit), 4).alias("top1_accuracy"), F.count(F.lit(1)).alias("n_queries")
    ).join(wide, "group").select("group", F.lit(k).alias("k_shots"), "top1_accuracy", "n_labels", "n_queries")


def run_summary(few: DataFrame, latency: DataFrame, compared: DataFrame) -> DataFrame:
    """Key/value rows: mean accuracy per (model, k), mean latency per model, both accuracies of a comparison."""
    accuracy = few.groupBy("model", "k_shots").agg(F.round(F.avg("top1_accuracy"), 4).alias("value"))
    parts = accuracy.select(F.format_string("%s_K%d_mean_acc", "model", "k_shots").alias("key"), "value")
    parts = parts.unionByName(latency.select(F.concat("model", F.lit("_latency_mean_ms")).alias("key"), F.col("mean").alias("value")))
    both = compared.agg(
        F.round(F.avg(F.col("stock_correct").cast("int")), 4).alias("stock_accuracy"),
        F.round(F.avg(F.col("bank_correct").cast("int")), 4).alias("bank_accuracy"),
    )
    return parts.unionByName(both.selectExpr("stack(2, 'stock_accuracy', stock_accuracy, 'bank_accuracy', bank_accuracy) AS (key, value)"))


def sample_statistics(df: DataFrame, value: str, keys: list[str], digits: int = 2) -> DataFrame:
    """Mean, population deviation, extremes and count."""
    r = lambda c: F.round(c, digits)
    return df.groupBy(*keys).agg(
        r(F.avg(value)).alias("mean"), r(F.stddev_pop(value)).alias("std"), r(F.min(value)).alias("min"),
        r(F.max(value)).alias("max"), F.count(value).alias("n"),
    )


def compare_predictions(one: DataFrame, two: DataFrame, truth: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """Two prediction tables side by side per item with correctness flags."""
    a = one.select(id_col, F.col("best_label").alias("stock_label"), F.round("score", 6).alias("stock_score"))
    b = two.select(id_col, F.col("best_label").alias("bank_label"), F.round("score", 6).alias("bank_score"))
    both = truth.select(id_col, label).join(a, id_col).join(b, id_col)
    return both.withColumns(
        {"stock_correct": F.col("stock_label") == F.col(label), "bank_correct": F.col("bank_label") == F.col(label)}
    )


def recall_report(scored: DataFrame, labels: DataFrame, theta: float, truth: str = "label") -> DataFrame:
    """Per label: recall at ``theta``, mean similarity and held-out count; a label without queries keeps nulls."""
    d = decide(scored, theta)
    hit = (F.col("is_known") & (F.col("best_label") == F.col(truth))).cast("int")
    measured = d.groupBy(F.col(truth).alias("label")).agg(
        F.round(100.0 * F.avg(hit), 4).alias("recall"), F.round(F.avg("true_score"), 6).alias("similarity"),
        F.count(F.lit(1)).alias("n"),
    )
    return labels.join(measured, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def diagnosis(recall: Column, similarity: Column, taxon: Column, n: Column) -> Column:
    """A plain explanation of a label's recall, by the first rule that applies."""
    group = F.lower(taxon)
    return (
        F.when(recall.isNull(), "not measured")
        .when(recall >= 80.0, "compact prototype")
        .when(recall >= 50.0, "distinct, moderate variance")
        .when(similarity >= 0.70, "close to the threshold")
        .when((group == "aves") & (n >= 20), "wide repertoire")
        .when(group == "aves", "needs more examples")
        .when(group == "insecta", "high-frequency signal")
        .when(group == "amphibia", "low-frequency pulses")
        .when(group == "mammalia", "short transients")
        .otherwise("needs denser examples")
    )


def ranked_report(report: DataFrame, n: int | None = None) -> DataFrame:
    """Rank by recall, similarity and count, all descending; missing values come last."""
    order = [F.desc_nulls_last("recall"), F.desc_nulls_last("similarity"), F.desc("n"), F.asc("label")]
    ranked = ranked_globally(report, order)
    return ranked.filter(F.col("rank") <= n) if n else ranked


def rejection_rate(scored: DataFrame, thetas: list[float]) -> DataFrame:
    """Share of (out-of-bank) queries rejected at each theta."""
    rows = scored.select(F.get("candidates", F.lit(0))["score"].alias("s"))
    return swept(rows, "s", thetas, {"n": F.lit(1)}).select(
        "theta", F.col("n_total").alias("n"), (F.col("n_total") - F.col("n")).alias("rejected"),
        F.round((F.col("n_total") - F.col("n")) / F.col("n_total"), 6).alias("rejection_rate"),
    )


def closed_set(scored: DataFrame, logits: Column, names: list, cuts: list[float], truth: str = "label") -> DataFrame:
    """Baseline without open-set logic: sigmoid of the logits, best class, tallied by confidence cut."""
    confidences = F.transform(logits, lambda x: V.sigmoid(x))
    classes = F.array(*[F.lit(n) for n in names])
    rows = scored.withColumn("__c", confidences).select(
        F.array_max("__c").alias("s"),
        (F.element_at(classes, (V.argmax(F.col("__c")) + 1).cast("int")) == F.col(truth)).cast("long").alias("hit"),
    )
    found = swept(rows, "s", cuts, {"correct": F.col("hit"), "wrong": 1 - F.col("hit")})
    total = F.col("correct_total") + F.col("wrong_total")
    return found.select(
        F.col("theta").alias("cut"), "correct", "wrong", (total - F.col("correct") - F.col("wrong")).alias("none")
    )
