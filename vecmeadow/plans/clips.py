"""Clip queries. Clips are runs of 120 events of a user, with the value / 1000 as sample."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from vecmeadow.functions import embed as M, signal as G, vectors as V
from vecmeadow.functions.activity import activity
from vecmeadow.operators import audit, bank as B
from vecmeadow.operators.ordered import first_rows
from vecmeadow.plans.registry import query
from vecmeadow.plans.scalars import D, entries
from vecmeadow.plans.series import FRAMED, framed
from vecmeadow.plans.sql import RANKED, UNITS, centroids
from vecmeadow.plans.vectors import long_sql
from vecmeadow.sources import audio as A, catalog as C

RATE = 40


def clips(t):
    """``user_id, clip, samples``; a clip is at most 120 samples long."""
    ordered = F.array_sort(F.collect_list(F.struct("frame", (F.col("value") / 1000.0).alias("x"))))
    return framed(t).groupBy("user_id", "clip").agg(F.transform(ordered, lambda s: s["x"]).alias("samples"))


CLIPS = FRAMED + ", clips AS (SELECT user_id, clip, list(value / 1000.0::DOUBLE ORDER BY frame) AS s FROM framed GROUP BY ALL)"


def wav_bytes(samples):
    """16-bit mono containers; a clip peaking above 0.3 gets a wrong magic, one under 5 samples no header."""

    def run(rows: pd.Series) -> pd.Series:
        out = []
        for x in rows:
            x = np.asarray(x)
            body = np.floor(x * 32767).astype("<i2").tobytes()
            magic = b"RIFX" if x.max() > 0.3 else b"RIFF"
            head = magic + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE * 2, 2, 16)
            out.append(b"RIF" if len(x) < 5 else head + b"data" + struct.pack("<I", len(body)) + body)
        return pd.Series(out)

    return F.pandas_udf(run, "binary")(samples)


def files(t):
    path = F.concat_ws("/", F.lit("clips"), F.col("user_id").cast("string"), F.concat(F.col("clip").cast("string"), F.lit(".wav")))
    return clips(t).select("user_id", "clip", path.alias("path"), wav_bytes("samples").alias("content"))


@query(
    "s2_container_check",
    f"WITH {CLIPS} SELECT user_id, clip, CASE WHEN len(s) < 5 THEN 'header too short' WHEN list_max(s) > 0.3 THEN 'not RIFF/WAVE' END AS reason FROM clips",
)
def _(t):
    return files(t).select("user_id", "clip", A.reject_reason(F.col("content"), F.col("path")).alias("reason"))


@query(
    "s3_pcm_decode",
    f"WITH {CLIPS}, q AS (SELECT user_id, clip, list_transform(s, lambda x: floor(x * 32767) / 32768) AS q FROM clips WHERE len(s) >= 5 AND list_max(s) <= 0.3) "
    f"SELECT user_id, clip, {RATE}::INTEGER AS rate, 1::INTEGER AS channels, len(q) AS n, round(list_sum(q), 5) AS total FROM q",
)
def _(t):
    good, _ = A.good_and_rejected(files(t))
    d = A.decode(good).filter("error IS NULL")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return d.select("user_id", "clip", "rate", "channels", F.size("samples").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query(
    "s4_segment_manifest",
    f"WITH {CLIPS}, g AS (SELECT user_id, clip, i AS seg_idx, s[i * 30 + 1:i * 30 + 30] AS s FROM clips, range(4) r(i) WHERE len(s) >= 30 AND i * 30 + 30 <= len(s) "
    "UNION ALL SELECT user_id, clip, 0, list_concat(s, list_transform(range(30 - len(s)), lambda x: 0.0::DOUBLE)) FROM clips WHERE len(s) < 30) "
    "SELECT user_id, clip, seg_idx, 30::BIGINT AS frames, 0.75::DOUBLE AS duration, round(list_max(s), 6) AS peak, round(sqrt(list_dot_product(s, s) / 30), 6) AS rms, 64::BIGINT AS hash_digits FROM g",
)
def _(t):
    """Segments of 30 samples (0.75 s)."""
    seg = A.segments(clips(t), "samples", 30, 30, least=1).withColumn("rate", F.lit(RATE))
    m = A.manifest(seg, "samples", "rate")
    r = lambda c: F.round(c, 6).alias(c)
    return m.select("user_id", "clip", "seg_idx", "frames", "duration", r("peak"), r("rms"), F.length("sha256").cast("long").alias("hash_digits"))


@query(
    "p15_clip_audit",
    f"WITH {CLIPS}, a AS (SELECT user_id, clip, len(s) AS n, list_min(s) AS lo, list_max(s) AS hi, list_avg(s) AS m, sqrt(list_dot_product(s, s) / len(s)) AS r FROM clips), "
    "b AS (SELECT *, greatest(abs(lo), abs(hi)) AS pk FROM a) SELECT user_id, clip, concat_ws(',', CASE WHEN n <> 60 THEN 'length' END, "
    "CASE WHEN abs(m) >= 0.02 THEN 'dc offset' END, CASE WHEN r <= 0.001 THEN 'too quiet' END, CASE WHEN pk < 0.1 THEN 'peak low' END, CASE WHEN pk > 1.0001 THEN 'peak high' END) AS reasons, "
    "n = 60 AND abs(m) < 0.02 AND r > 0.001 AND pk >= 0.1 AND pk <= 1.0001 AS passed FROM b",
)
def _(t):
    """Clips should have 60 samples, little offset and a peak of at least 0.1."""
    stats = A.sample_statistics(clips(t).withColumns({"rate": F.lit(RATE), "channels": F.lit(1)}), "samples")
    found = audit.clip_audit(stats, want_rate=RATE, want_frames=60, dc=0.02, peak_range=(0.1, 1.0001))
    return found.select("user_id", "clip", F.concat_ws(",", "reasons").alias("reasons"), "passed")


@query("f16_blob_round_trip", "SELECT vec_id, true AS same, (4 * len(embedding))::BIGINT AS bytes FROM embeddings")
def _(t):
    blob = A.float_blob(F.col("embedding"))
    df = t.embeddings.select("vec_id", "embedding", blob.alias("b"))
    return df.select("vec_id", (A.blob_floats(F.col("b")) == F.col("embedding")).alias("same"), F.octet_length("b").cast("long").alias("bytes"))


@query("x1_embedding_model", f"WITH {UNITS} {long_sql('units', 'vec_id', 'v')}")
def _(t):
    """The contract with a model that only scales: clips are the vectors themselves."""

    def model():
        return lambda clips: clips / np.linalg.norm(clips, axis=1, keepdims=True)

    df = M.embed(t.embeddings.select("vec_id", F.col("embedding").alias("samples")), model, 64)
    return entries(df, "vec_id", "embedding")


@query(
    "x3_segment_udtf",
    f"SELECT vec_id, i AS seg_idx, i * 7 AS start, round(list_sum(v[i * 7 + 1:least(64, i * 7 + 20)]), 6) AS total FROM ({D}), range(8) r(i)",
)
def _(t):
    """The SQL form: windows of 20 every 7 with the tail padded."""
    A.register_segment_udtf(t.spark, "segment")
    t.embeddings.createOrReplaceTempView("clip_vectors")
    return t.spark.sql(
        "SELECT vec_id, s.seg_idx, s.start, round(aggregate(s.samples, 0D, (a, x) -> a + x), 6) AS total "
        "FROM clip_vectors, LATERAL segment(CAST(embedding AS ARRAY<DOUBLE>), 20, 7, true, 1, 1) s"
    )


@query(
    "x4_frame_rms",
    f"WITH {CLIPS} SELECT user_id, clip, i AS frame, round(sqrt((s[i + 1] * s[i + 1] + s[i + 2] * s[i + 2]) / 2 + 1e-12), 6) AS rms FROM clips, range(119) r(i) WHERE i + 2 <= len(s) "
    "UNION ALL SELECT user_id, clip, 0, round(sqrt(s[1] * s[1] / 2 + 1e-12), 6) FROM clips WHERE len(s) = 1",
)
def _(t):
    """Frames of two samples, one apart."""
    levels = G.frame_rms(F.col("samples"), 2, 1)
    return clips(t).select("user_id", "clip", F.posexplode(levels).alias("f", "x")).select(
        "user_id", "clip", F.col("f").cast("long").alias("frame"), F.round("x", 6).alias("rms")
    )


@query(
    "x5_activity",
    f"WITH RECURSIVE {CLIPS}, fr AS (SELECT user_id, clip, i AS frame, sqrt((s[i + 1] * s[i + 1] + s[i + 2] * s[i + 2]) / 2 + 1e-12) AS value FROM clips, range(119) r(i) WHERE i + 2 <= len(s) "
    "UNION ALL SELECT user_id, clip, 0, sqrt(s[1] * s[1] / 2 + 1e-12) FROM clips WHERE len(s) = 1), "
    "f0 AS (SELECT user_id, clip, greatest(1e-4::DOUBLE, quantile_cont(value, 0.15)) AS f0 FROM fr WHERE frame < 40 GROUP BY ALL), "
    "walk AS (SELECT user_id, clip, -1::BIGINT AS frame, f0 AS floor, false AS triggered FROM f0 UNION ALL "
    "SELECT w.user_id, w.clip, f.frame, greatest(1e-4::DOUBLE, CASE WHEN f.value > 3 * w.floor THEN w.floor WHEN f.value < w.floor THEN 0.95::DOUBLE * w.floor + 0.05::DOUBLE * f.value "
    "ELSE 0.99::DOUBLE * w.floor + 0.01::DOUBLE * f.value END), f.value > 3 * w.floor FROM walk w JOIN fr f ON f.user_id = w.user_id AND f.clip = w.clip AND f.frame = w.frame + 1), "
    "isl AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, clip ORDER BY frame) AS i FROM walk WHERE frame >= 0 AND triggered), "
    "runs AS (SELECT user_id, clip, count(*) AS n FROM isl GROUP BY user_id, clip, i HAVING count(*) >= 4), "
    "rc AS (SELECT user_id, clip, count(*) AS k FROM runs GROUP BY ALL), "
    "st AS (SELECT w.user_id, w.clip, avg(floor) AS nf, count(*) AS n, sum(triggered::INT)::BIGINT AS tr FROM walk w WHERE frame >= 0 GROUP BY ALL), "
    "pk AS (SELECT user_id, clip, max(value) AS pk FROM fr GROUP BY ALL) "
    "SELECT user_id, clip, coalesce(k, 0) > 0 AS is_vocal, round(pk, 6) AS peak_rms, round(nf, 6) AS noise_floor, n AS frame_count, tr AS triggered_frames, coalesce(k, 0) AS n_intervals "
    "FROM st JOIN pk USING (user_id, clip) LEFT JOIN rc USING (user_id, clip)",
)
def _(t):
    """At 40 samples a second a frame is two samples; four frames make an event."""
    df = clips(t).select("user_id", "clip", activity("samples", RATE, least=4).alias("a"))
    r = lambda c: F.round(F.col(f"a.{c}"), 6).alias(c)
    return df.select(
        "user_id", "clip", "a.is_vocal", r("peak_rms"), r("noise_floor"), "a.frame_count", "a.triggered_frames",
        F.size("a.intervals").cast("long").alias("n_intervals"),
    )


@query("m9_prototype_map")
def _(t):
    """Two principal components of the centred vectors, averaged per label, with the explained variance."""
    df = B.centre(t.embeddings, zero="keep")
    mean = B.mean_as_column(df)
    vectors = df.select("label", array_to_vector(F.zip_with("embedding", mean, lambda x, m: x - m)).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(vectors)
    share = [float(x) for x in model.explainedVariance]
    return model.transform(vectors).select("label", vector_to_array("p").alias("p")).groupBy("label").agg(
        F.round(F.avg(F.col("p")[0]), 6).alias("x"), F.round(F.avg(F.col("p")[1]), 6).alias("y")
    ).withColumns({"x_share": F.lit(share[0]), "y_share": F.lit(share[1])})


@query(
    "m11_enrol_directory",
    f"WITH {RANKED}, " + centroids("bank", "ranked", where="rn <= 10")
    + f" SELECT b.label, b.n AS sample_count, 0.35::DOUBLE AS radius, coalesce(k.taxon, 'aves') AS taxon, round(b.c[1], 6) AS first_entry FROM bank b LEFT JOIN (SELECT * FROM (VALUES {', '.join(repr((r[0], r[4])) for r in C.default_species())}) v(position, taxon)) k ON k.position = b.label",
)
def _(t):
    """First ten clips per label to bank rows with a constant radius and the catalogue's taxon."""
    bank = B.fit_bank(first_rows(t.embeddings, ["label"], [F.col("vec_id")], 10))
    kinds = C.species(t.spark).select(F.col("position").alias("label"), "taxon")
    return bank.join(F.broadcast(kinds), "label", "left").select(
        "label", F.col("n_support").alias("sample_count"), F.lit(0.35).alias("radius"), F.coalesce("taxon", F.lit("aves")).alias("taxon"),
        F.round(F.col("centroid")[0], 6).alias("first_entry"),
    )
