"""URL filter: rules first, then a tree of path templates per host.

Segments that are numbers or long hexadecimal strings are variable at sight.
After that the tree is built level by level. Below each node, a branch with few
urls is variable; a branch whose tails (the shapes of the rest of the path) and
whose labels do not differ from the whole node's by a chi-square and a
two-proportion test is merged into the wildcard branch; the others, and the only
branch of a node, stay literal. There are as many levels as nodes of enough urls
are deep; below a node of too few, every segment is variable.
The finished template of a url is rejected when its labelled purity, smoothed
towards its host's and that towards the whole table's, reaches a threshold.
Urls that a rule judges are the labelled ones.

All statistics are sums over (host, path shape) groups, made before any
shuffle, so a host with a third of all urls sends one row per shape and task.

A null url, or one without ``://``, has an empty host and path and is judged like
any other. Repeated rows come back repeated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmeadow.session import scratch_table, small_side

MIN_SUPPORT = 10
SMOOTHING = 5.0
REJECT_AT = 0.8
DEVIATIONS = 3.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEP = "\x01"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; ``rules`` is configuration and travels in the plan."""
    rows = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r)):
        at = rule.find("/")
        rows.append((rule[:at] if at >= 0 else rule, rule[at:] if at >= 0 else "", rule, verdict))
    known = F.array(
        *[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "rule", "verdict"))]) for r in rows]
    )
    fits = lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])
    return F.get(F.filter(known, fits), 0)


def segment_shape(segment: Column) -> Column:
    """A segment with numbers and long hexadecimal strings made variable."""
    return F.regexp_replace(
        F.regexp_replace(segment, r"^(?=[0-9a-f-]*\d)[0-9a-f]{8,}(?:-[0-9a-f]+)*(?=$|\.)", "{hex}"), r"\d+", "{n}"
    )


def _branches(tree: DataFrame) -> DataFrame:
    """(host, prefix, seg) of one level that stay literal."""
    tails = tree.groupBy("host", "prefix", "seg", "tail").agg(F.sum("n").alias("n"), F.sum("nl").alias("nl"), F.sum("nb").alias("nb"))
    cells = tails.groupBy("host", "prefix", "tail").agg(F.sum("n").alias("cell"))
    nodes = tails.groupBy("host", "prefix").agg(
        F.sum("n").alias("all"), F.sum("nl").alias("all_l"), F.sum("nb").alias("all_b"), F.count_distinct("tail").alias("kinds")
    )
    # Sum over the branch's cells of observed^2 / expected, less its size, is the chi-square with the empty cells.
    fit = (
        tails.join(cells, ["host", "prefix", "tail"])
        .groupBy("host", "prefix", "seg")
        .agg(F.sum("n").alias("n"), F.sum("nl").alias("nl"), F.sum("nb").alias("nb"), F.sum(F.col("n") * F.col("n") / F.col("cell")).alias("ratio"))
        .join(nodes, ["host", "prefix"])
    )
    chi = F.col("ratio") * F.col("all") / F.col("n") - F.col("n")
    freedom = F.col("kinds") - 1
    same_tails = chi <= freedom + DEVIATIONS * F.sqrt(2.0 * freedom) + 1e-9
    share = F.col("all_b") / F.col("all_l")
    spread = F.sqrt(share * (1 - share) / F.col("nl"))
    same_labels = (F.col("nl") == 0) | (F.abs(F.col("nb") / F.col("nl") - share) <= DEVIATIONS * spread + 1e-9)
    alone = F.col("n") == F.col("all")
    return fit.where((F.col("n") >= MIN_SUPPORT) & (alone | ~(same_tails & same_labels))).select("host", "prefix", "seg")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    smoothing: float = SMOOTHING,
    reject_at: float = REJECT_AT,
) -> DataFrame:
    """Rows (id, host, path, rule, verdict, template, purity), one per page."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    rows = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .select("id", host.alias("host"), path.alias("path"))
        .withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
        .withColumn("shape", F.array_join(F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), segment_shape), SEP))
    )
    # Distinct path shapes with their labels; what follows works on these alone.
    path_of = lambda name: scratch_table(spark, f"url-{name}")
    groups_path = path_of("shapes")
    labelled = F.col("hit").isNotNull()
    rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count_if(labelled).alias("nl"), F.count_if(F.col("hit.verdict") == "block").alias("nb")
    ).write.parquet(groups_path)
    groups = spark.read.parquet(groups_path)
    l_all, b_all = groups.agg(F.sum("nl"), F.sum("nb")).first()
    tree = groups.select(
        "host", "shape", "n", "nl", "nb", F.lit("").alias("prefix"),
        F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", SEP)).alias("rest"),
    )
    # A row is finished at its last segment, or in a node too small to have a literal branch: then all that follows is variable.
    templates_path = path_of("templates")
    going_on = (F.size("rest") > 0) & (F.col("node_n") >= MIN_SUPPORT)
    while True:
        sums = tree.groupBy("host", "prefix").agg(F.sum("n").alias("node_n"))
        node_path = path_of("nodes")
        tree.join(sums, ["host", "prefix"]).withColumn("open", going_on).write.parquet(node_path)
        split = spark.read.parquet(node_path)
        split.where("not open").select(
            "host", "shape", "n", "nl", "nb", F.concat("prefix", F.repeat(F.lit("/*"), F.size("rest"))).alias("template")
        ).write.mode("append").parquet(templates_path)
        here = split.where("open").withColumn("seg", F.get("rest", F.lit(0))).withColumn("tail", F.array_join(F.slice("rest", 2, 1 << 20), SEP))
        if here.isEmpty():
            break
        literal = _branches(here).withColumn("literal", F.lit(True))
        tree = here.join(literal, ["host", "prefix", "seg"], "left").select(
            "host", "shape", "n", "nl", "nb",
            F.concat("prefix", F.lit("/"), F.when(F.col("literal"), F.col("seg")).otherwise("*")).alias("prefix"),
            F.slice("rest", 2, 1 << 20).alias("rest"),
        )
        level_path = path_of("level")
        tree.write.parquet(level_path)
        tree = spark.read.parquet(level_path)
    templates = spark.read.parquet(templates_path)
    overall = (b_all or 0) / l_all if l_all else 0.0
    smooth = lambda nb, nl, prior: (nb + smoothing * prior) / (nl + smoothing)
    hosts = templates.groupBy("host").agg(smooth(F.sum("nb"), F.sum("nl"), F.lit(overall)).alias("prior"))
    purity = (
        templates.groupBy("host", "template").agg(F.sum("nb").alias("nb"), F.sum("nl").alias("nl"))
        .join(hosts, "host")
        .select("host", "template", smooth(F.col("nb"), F.col("nl"), F.col("prior")).alias("purity"))
    )
    verdicts_path = path_of("verdicts")
    templates.select("host", "shape", "template").join(purity, ["host", "template"]).write.parquet(verdicts_path)
    verdicts = small_side(spark.read.parquet(verdicts_path))
    return rows.join(verdicts, ["host", "shape"]).select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("purity") >= reject_at, "block").otherwise("allow")).alias("verdict"),
        "template", "purity",
    )
