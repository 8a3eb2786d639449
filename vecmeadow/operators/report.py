"""Relational reports over the detection log and label dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmeadow.functions.text import taxon_label, title_from_slug
from vecmeadow.session import scratch_table, small_side


def is_known(label: Column) -> Column:
    return F.lower(label) != "unknown"


def query_log(log: DataFrame, label: str | None, limit: int, label_col: str, order: list[Column]) -> DataFrame:
    """The ``limit`` newest rows of the log, optionally of one label."""
    if limit < 1:
        raise ValueError("a log report needs a limit of at least 1")
    rows = log if label is None else log.filter(F.col(label_col) == label)
    return rows.orderBy(*order).limit(limit)


def named_detections(log: DataFrame, stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Common name and taxon per detection: stored, else catalog, else the title-cased label."""
    rows = log.join(stored.select("label", F.col("common_name").alias("__s"), F.col("taxon").alias("__st")), "label", "left")
    rows = rows.join(catalog.select("label", F.col("common_name").alias("__c"), F.col("taxon").alias("__ct")), "label", "left")
    name = F.coalesce(F.nullif("__s", F.lit("")), "__c", title_from_slug(F.col("label")))
    return rows.withColumns({"common_name": name, "taxon": taxon_label(F.coalesce("__st", "__ct"))}).drop(
        "__s", "__st", "__c", "__ct"
    )


def top_by_count(df: DataFrame, keys: list[str], n: int, *measures: Column) -> DataFrame:
    """The ``n`` most frequent keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *measures).orderBy(F.desc("n"), *keys).limit(n)


def station_totals(**frames: DataFrame) -> DataFrame:
    """One row with the row count of every named frame."""
    counts = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = row if counts is None else counts.unionByName(row)
    return counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in frames])


def status_tally(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.sum((F.col(status) == v).cast("long")).alias(v) for v in values], F.count(F.lit(1)).alias("total")
    )


def counts_with_total(df: DataFrame, group: str, label: Column, items: Column) -> DataFrame:
    """Distinct labels and items per group, plus a ``Total`` row.

    Labels are counted after one aggregate per (group, label), so the distinct
    count sees label-sized input.
    """
    per_label = df.groupBy(F.col(group), label.alias("__label")).agg(F.sum(items).alias("__items"))
    rolled = per_label.rollup(group).agg(
        F.grouping(group).alias("__g"), F.count("__label").alias("labels"), F.sum("__items").alias("items")
    )
    name = F.when(F.col("__g") == 1, "Total").otherwise(F.col(group).cast("string"))
    return rolled.select(name.alias(group), "labels", "items")


def pivot_mean(df: DataFrame, row: str, column: str, values: list, measure: str, digits: int = 4) -> DataFrame:
    """Mean per cell; an absent cell stays null."""
    return df.groupBy(row).pivot(column, values).agg(F.round(F.avg(measure), digits))


def shared_ids(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """Ids that occur under more than one label: how many labels, and the smallest and largest of them.

    A count per id, not the pairs of labels, so an id under many labels stays one row.
    """
    return (
        df.select(id_col, label).distinct().groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("labels"), F.min(label).alias("first_label"), F.max(label).alias("last_label"))
        .filter("labels > 1")
    )


def duplicate_content(df: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """Content hashes held by several rows."""
    return (
        df.groupBy(digest.alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")
    )


# Two neighbouring words of a text and what lies between them; the second word is the first of the next pair.
_WORD = r"[\p{L}\p{N}]"
_PAIR = rf"(?<!{_WORD})(?=({_WORD}+[^\p{{L}}\p{{N}}]+{_WORD}+))"
LETTERS = 6  # characters of the grams of names without two inner words


def _grams(text: Column, letters: int) -> Column:
    """Distinct overlapping grams: pairs of words for 0, else so many characters."""
    pattern = _PAIR if letters == 0 else f"(?s)(?=(.{{{letters}}}))"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def vocabulary_matches(names: DataFrame, lines: DataFrame, name_id: str, name: str, line_id: str, line: str) -> DataFrame:
    """For each name, the smallest line id whose text contains it (case ignored), or null.

    A join on an inverted index. A name is keyed by the rarest of its grams: pairs of words that do not touch its ends, which
    every line with the name has as pairs of its own; or, in names without such a pair, runs of ``LETTERS`` characters, and all
    characters of shorter names. Lines give their grams of the kinds that occur; those of no name drop out before the first shuffle that
    counts them. Lines with a name's rarest gram are candidates, and the texts of candidates are compared. Empty and null names match nothing.
    """
    spark = names.sparkSession
    low = names.select(F.lower(name).alias("term")).filter("term <> ''").distinct()
    # Words at the ends may go on in a line.
    inner = F.regexp_replace("term", rf"^{_WORD}+|{_WORD}+$", "")
    low = low.withColumn("__pairs", _grams(inner, 0))
    low = low.withColumn("letters", F.when(F.size("__pairs") > 0, 0).otherwise(F.least(F.lit(LETTERS), F.char_length("term"))))
    own = F.when(F.col("letters") == 0, F.col("__pairs"))
    for n in range(1, LETTERS + 1):
        own = own.when(F.col("letters") == n, _grams(F.col("term"), n))
    path = scratch_table(spark, "name-grams")
    low.select("term", "letters", F.explode(own).alias("gram")).write.parquet(path)
    grams = spark.read.parquet(path)
    wanted = grams.select("letters", "gram").distinct()
    # At most LETTERS + 1 kinds.
    kinds = sorted(r[0] for r in wanted.select("letters").distinct().collect())
    path = scratch_table(spark, "name-hits")
    texts = lines.select(F.col(line_id).alias("line"), F.lower(line).alias("text")).filter("line IS NOT NULL AND text IS NOT NULL")
    empty = lines.select(F.col(line_id).alias("line")).limit(0).withColumns({"letters": F.lit(0), "gram": F.lit("")})
    empty.write.parquet(path)
    for n in kinds:
        found = texts.select("line", F.explode(_grams(F.col("text"), n)).alias("gram"))
        hit = found.join(small_side(wanted.filter(F.col("letters") == n).select("gram")), "gram", "left_semi")
        hit.select("line", F.lit(n).alias("letters"), "gram").write.mode("append").parquet(path)
    hits = spark.read.parquet(path)
    counted = hits.groupBy("letters", "gram").agg(F.count(F.lit(1)).alias("n"))
    # A name with a gram of no line is in no line.
    rated = grams.join(counted, ["letters", "gram"], "left")
    keys = rated.groupBy("term", "letters").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    keys = keys.filter("best.n > 0").select("term", "letters", F.col("best.gram").alias("gram"))
    path = scratch_table(spark, "name-candidates")
    hits.join(keys, ["letters", "gram"]).select("line", "term").write.parquet(path)
    # The texts stay where they are if the candidates are few.
    held = texts.join(small_side(spark.read.parquet(path)), "line").filter(F.contains("text", "term"))
    first = held.groupBy("term").agg(F.min("line").alias("first_line"))
    return (
        names.withColumn("__t", F.lower(name)).join(first, F.col("__t") == F.col("term"), "left").drop("__t", "term")
        .withColumn("in_vocabulary", F.col("first_line").isNotNull())
    )
