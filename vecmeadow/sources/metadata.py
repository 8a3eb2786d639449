"""Recording metadata, label lists and fetch planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmeadow.operators.ordered import first_rows

# The fields of a recording in a search result.
RECORDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("gen", T.StringType()),
        T.StructField("sp", T.StringType()),
        T.StructField("en", T.StringType()),
        T.StructField("cnt", T.StringType()),
        T.StructField("q", T.StringType()),
        T.StructField("length", T.StringType()),
        T.StructField("lic", T.StringType()),
        T.StructField("rec", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("also", T.ArrayType(T.StringType())),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("recordings", T.ArrayType(RECORDING)),
    ]
)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Search result pages (one JSON object per file or line) to one row per recording, page order kept."""
    pages = spark.read.schema(PAGE).json(path)
    return pages.select("label", "page", F.posexplode("recordings").alias("position", "r")).select(
        "label", (F.col("page").cast("long") * 1_000_000 + F.col("position")).alias("place"), "r.*"
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per-label manifests whose ``recordings`` is a map of id to details."""
    details = "struct<file_path:string,quality:string,status:string>"
    schema = f"species_id string, recordings map<string,{details}>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("species_id", F.explode("recordings").alias("recording_id", "r")).select(
        "species_id", "recording_id", "r.*"
    )


def wanted_recordings(
    df: DataFrame, label: str, quality: str, order: list[Column], target: int, accept: list[str] | None = None
) -> DataFrame:
    """The first ``target`` recordings per label; a blank quality passes any filter."""
    if accept:
        grade = F.upper(F.coalesce(quality, F.lit("")))
        df = df.filter((grade == "") | grade.isin([a.upper() for a in accept]))
    return first_rows(df, [label], order, target)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of both with the latest row per key. A partial aggregate, not a sort per key."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return both.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def label_list(df: DataFrame, text: str) -> DataFrame:
    """Distinct non-blank names from newline or comma separated text."""
    parts = F.explode(F.split(F.col(text), "[\n,]"))
    # A set of characters to trim; a pattern anchored at the end backtracks on long runs of blanks.
    name = F.trim(F.col("name"), F.lit(" \t\n\x0b\f\r"))
    return df.select(parts.alias("name")).select(name.alias("name")).filter("name <> ''").distinct()


def found_ids(html: Column, pattern: str, n: int) -> Column:
    """The first ``n`` different matches in order of appearance; works on one row, so nothing is shuffled."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), 1, n)


def first_distinct(df: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """The first ``n`` different values over many rows, by first occurrence."""
    first = df.groupBy(column).agg(F.min(order).alias(order))
    return first.orderBy(order, column).limit(n)


def purge(df: DataFrame, path: str, patterns: list[str], bad_ids: list[str], label: str, allowed: list[str]) -> DataFrame:
    """Drop paths like any pattern, and paths containing a bad id unless their label is allowed."""
    bad = F.lit(False)
    for p in patterns:
        bad = bad | F.col(path).like(p)
    if bad_ids:
        holds = F.lit(False)
        for b in bad_ids:
            holds = holds | F.col(path).contains(b)
        bad = bad | (holds & ~F.col(label).isin(allowed))
    return df.filter(~bad)


def fetch_plan(
    wanted: DataFrame, present: DataFrame, done: DataFrame, order: list[Column], per_label: int,
    least_bytes: int = 100, enough: int = 10, force: bool = False,
) -> DataFrame:
    """What to fetch: ``wanted(label, id)`` without valid files in ``present(id, bytes)``, without
    labels that have ``enough`` segments in ``done(label, n)``, capped per label."""
    open_labels = done.filter(F.col("n") >= enough).select("label")
    rows = wanted.join(open_labels, "label", "left_anti")
    if not force:
        rows = rows.join(present.filter(F.col("bytes") > least_bytes).select("id"), "id", "left_anti")
    return first_rows(rows, ["label"], order, per_label)


def union_files(*frames: DataFrame) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def top_up(strict: DataFrame, relaxed: DataFrame, label: str, name: str, target: int) -> DataFrame:
    """The strict rows plus, for labels still below ``target``, relaxed rows with new names up to the target."""
    have = strict.groupBy(label).agg(F.count(F.lit(1)).alias("__have"))
    fresh = relaxed.join(strict.select(label, name), [label, name], "left_anti").join(have, label, "left")
    fresh = fresh.filter(F.coalesce("__have", F.lit(0)) < target)
    ranked = first_rows(fresh, [label], [F.col(name)], target, "__r")
    added = ranked.filter(F.col("__r") <= target - F.coalesce("__have", F.lit(0))).drop("__r", "__have")
    return strict.withColumn("pass", F.lit("strict")).unionByName(added.withColumn("pass", F.lit("relaxed")))


def not_enrolled(requested: DataFrame, enrolled: DataFrame, label: str = "label") -> DataFrame:
    return requested.select(label).distinct().join(enrolled.select(label), label, "left_anti")


def shared_labels(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    return a.select(label).intersect(b.select(label))


def under_represented(labels: DataFrame, items: DataFrame, label: str, target: int) -> DataFrame:
    """Labels with fewer than ``target`` items, none included, fewest first."""
    counts = items.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows = labels.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.filter(F.col("n") < target).orderBy("n", label)
