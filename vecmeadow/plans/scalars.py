"""Scalar, array and path functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmeadow.functions import signal as G, text as X, vectors as V
from vecmeadow.plans.registry import query

D = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def entries(df, key: str, vector: str):
    return df.select(key, F.posexplode(vector).alias("p", "x")).select(
        key, (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x")
    )


ENTRIES = "SELECT vec_id, i, round(x, 6) AS x FROM (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ({}))"


@query("f1_slug", "SELECT p_partkey, replace(lower(trim(p_name)), ' ', '_') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query(
    "f2_f3_titles",
    "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, upper(p_type[1]) || lower(p_type[2:]) AS taxon FROM part",
)
def _(t):
    return t.part.select(
        "p_partkey", X.title_from_slug(X.slug(F.col("p_name"))).alias("title"), X.taxon_label(F.col("p_type")).alias("taxon")
    )


@query("f4_content_hash", "SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 16) AS short_hash FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", X.content_hash(F.col("text")).alias("full_hash"), X.content_hash(F.col("text"), 16).alias("short_hash")
    )


@query("f6_rms", f"SELECT vec_id, round(sqrt(list_dot_product(v, v) / len(v) + 1e-12), 6) AS rms FROM ({D})")
def _(t):
    return t.embeddings.select("vec_id", F.round(G.rms(F.col("embedding")), 6).alias("rms"))


@query(
    "f7_peak_normalise",
    ENTRIES.format(
        f"SELECT vec_id, list_transform(v, lambda x: greatest(-1, least(1, x * k))) AS w FROM (SELECT vec_id, v, CASE WHEN top < 1e-6 THEN 1 ELSE 0.95 / (top + 1e-10) END AS k FROM (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM ({D})))"
    ),
)
def _(t):
    return entries(t.embeddings.select("vec_id", G.peak_normalise(F.col("embedding")).alias("w")), "vec_id", "w")


@query(
    "f8_sanitise",
    ENTRIES.format(f"SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > 0.3 THEN 1 WHEN x < -0.3 THEN -1 WHEN abs(x) < 0.01 THEN 0 ELSE x END) AS w FROM ({D})"),
)
def _(t):
    """Large entries become infinities and tiny ones NaN, which are then repaired."""
    broken = F.transform(
        V.doubles(F.col("embedding")),
        lambda x: F.when(x > 0.3, float("inf")).when(x < -0.3, float("-inf")).when(F.abs(x) < 0.01, float("nan")).otherwise(x),
    )
    return entries(t.embeddings.select("vec_id", G.sanitise(broken).alias("w")), "vec_id", "w")


@query(
    "f9_fit_length",
    "SELECT vec_id, len(crop) AS cropped, round(crop[1], 6) AS crop_first, round(crop[20], 6) AS crop_last, 101::BIGINT AS padded, 0.0::DOUBLE AS pad_edge, round(v[1], 6) AS pad_first "
    f"FROM (SELECT vec_id, v, v[23:42] AS crop FROM ({D}))",
)
def _(t):
    """Crop 64 entries to the middle 20, and pad them to 101 (18 left, 19 right)."""
    df = t.embeddings.select("vec_id", G.fit_length(F.col("embedding"), 20).alias("c"), G.fit_length(F.col("embedding"), 101).alias("p"))
    r = lambda c: F.round(c, 6)
    return df.select(
        "vec_id", F.size("c").cast("long").alias("cropped"), r(F.col("c")[0]).alias("crop_first"), r(F.col("c")[19]).alias("crop_last"),
        F.size("p").cast("long").alias("padded"), F.greatest(F.col("p")[17], F.col("p")[82]).alias("pad_edge"), r(F.col("p")[18]).alias("pad_first"),
    )


@query(
    "f10_centred_window",
    "WITH c AS (SELECT vec_id, v, greatest(0, (label + label + 3) / 2.0::DOUBLE - 1.5::DOUBLE) AS b FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)), "
    "w AS (SELECT vec_id, v, CASE WHEN b + 3 > 8 THEN 5 ELSE b END::BIGINT * 8 AS s FROM c) SELECT vec_id, round(v[s + 1], 6) AS first_entry, round(v[s + 24], 6) AS last_entry, 24::BIGINT AS n FROM w",
)
def _(t):
    """64 entries at rate 8 are eight seconds; an event spans label to label + 3 seconds."""
    start = F.col("label").cast("double")
    w = G.centred_window(F.col("embedding"), start, start + 3, 24, 8)
    df = t.embeddings.select("vec_id", w.alias("w"))
    return df.select("vec_id", F.round(F.col("w")[0], 6).alias("first_entry"), F.round(F.col("w")[23], 6).alias("last_entry"), F.size("w").cast("long").alias("n"))


@query(
    "f11_segments",
    f"SELECT vec_id, i AS seg_idx, i * 7 AS start, round(list_sum(v[i * 7 + 1:i * 7 + 20]), 6) AS total FROM ({D}), range(7) r(i)",
)
def _(t):
    """Windows of 20 entries every 7."""
    v = V.doubles(F.col("embedding"))
    starts = G.segment_starts(F.size("embedding"), 20, 7, least=1)
    df = t.embeddings.select("vec_id", v.alias("v"), F.posexplode(starts).alias("seg_idx", "start"))
    total = F.aggregate(F.slice("v", F.col("start") + 1, 20), F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("start").cast("long").alias("start"), F.round(total, 6).alias("total"))


@query(
    "f12_downmix",
    f"SELECT vec_id, i + 1 AS i, round((v[2 * i + 1] + v[2 * i + 2]) / 2, 6) AS x FROM ({D}), range(32) r(i)",
)
def _(t):
    return entries(t.embeddings.select("vec_id", G.downmix(F.col("embedding"), 2).alias("w")), "vec_id", "w")


@query(
    "f17_paths",
    r"WITH n AS (SELECT page_id, split_part(url, '/', -1) AS f FROM pages) SELECT page_id, regexp_replace(f, '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(f, '.(\.[^.]+)$', 1)) AS ext, regexp_extract(f, '(\d{3,})', 1) AS rec_id FROM n",
)
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", X.stem(u).alias("stem"), X.extension(u).alias("ext"), X.recording_id(u).alias("rec_id"))


@query("f18_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, epoch_us(ts) AS us FROM events")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", X.to_iso(ts).alias("iso"), F.unix_micros(X.to_ts(X.to_iso(ts))).alias("us"))
