"""Containers, segments, activity, metadata and stores."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmeadow.functions import embed as M
from vecmeadow.functions.activity import activity
from vecmeadow.functions.floor import track
from vecmeadow.operators.bank import fit_bank
from vecmeadow.sources import audio as A, catalog as C, metadata as D, stores as ST


def wav(x, rate=48_000, channels=1, kind=1, bits=16):
    body = (np.asarray(x) * 32767).astype("<i2").tobytes() if kind == 1 else np.asarray(x, dtype="<f4").tobytes()
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def test_scan_checks_and_decoding(spark, tmp_path):
    (tmp_path / "crow").mkdir()
    (tmp_path / "owl").mkdir()
    contents = {"a": wav([0.5, -0.5] * 50), "b": b"", "c": b"RI", "d": b"RIFF1234", "e": b"RIFF0000AVI " + b"x" * 40, "f": b"RIFF0000WAVE"}
    contents["g"] = wav([0.5, 0.1] * 20, channels=2)
    contents["h"] = wav([np.nan, np.inf, -np.inf, 0.25], kind=3, bits=32)
    for name, body in contents.items():
        (tmp_path / "crow" / f"{name}.wav").write_bytes(body)
    (tmp_path / "owl" / "only.wav").write_bytes(wav([0.1]))
    files = A.scan(spark, str(tmp_path))
    assert {r.label for r in files.collect()} == {"crow"}
    good, bad = A.good_and_rejected(files)
    name = lambda r: r.path[-5]
    assert {name(r): r.reason for r in bad.collect()} == {
        "c": "header too short", "d": "truncated wav header", "e": "not RIFF/WAVE"
    }
    # Spark's own scan leaves out files of zero bytes; a file table from elsewhere may hold them.
    other = spark.createDataFrame([("x/b.wav", b""), ("x/m.wav", None)], "path string, content binary")
    reasons = other.select("path", A.reject_reason(F.col("content"), F.col("path")).alias("r")).collect()
    assert {r.path: r.r for r in reasons} == {"x/b.wav": "empty", "x/m.wav": "missing"}
    found = {name(r): r for r in A.decode(good).collect()}
    assert found["f"].error and found["f"].samples is None
    assert found["a"].rate == 48_000 and len(found["a"].samples) == 100 and abs(found["a"].samples[0] - 0.5) < 1e-3
    assert found["g"].channels == 2 and np.allclose(found["g"].samples, 0.3, atol=1e-3) and len(found["g"].samples) == 20
    assert found["h"].samples == [0.0, 1.0, -1.0, 0.25]


@pytest.mark.parametrize(
    "size, pad, count",
    [(0, False, 0), (50, False, 0), (99, False, 0), (100, False, 1), (1439, False, 1), (1440, False, 1), (1441, False, 1),
     (1441, True, 1), (2879, False, 1), (2879, True, 2), (2880, False, 2), (2881, False, 2)],
)
def test_segment_boundaries(spark, size, pad, count):
    df = spark.range(1).select("id", F.array_repeat(F.lit(0.5), size).alias("samples"))
    rows = A.segments(df, "samples", 1440, 1440, pad, 144).collect()
    assert len(rows) == count and all(len(r.samples) == 1440 for r in rows)
    assert len(list(A.SegmentUdtf().eval([0.5] * size, 1440, 1440, pad, 144, 100))) == count


def tone(ms, rate=48_000):
    rng = np.random.default_rng(0)
    x = 0.005 * rng.standard_normal(3 * rate)
    n = int(rate * ms / 1000)
    x[rate : rate + n] += 0.6 * np.sin(2 * np.pi * 2000 * np.arange(n) / rate)
    return [float(v) for v in x]


def test_clicks_are_rejected_and_calls_found(spark):
    lengths = [1, 100, 200, 240, 400, 1000]
    df = spark.createDataFrame([(ms, tone(ms)) for ms in lengths], "ms int, samples array<double>")
    got = {r.ms: r.a for r in df.select("ms", activity("samples").alias("a")).collect()}
    assert [got[ms].is_vocal for ms in lengths] == [False] * 4 + [True] * 2
    span = got[1000].intervals[0]
    assert abs(span.start - 1.0) < 0.06 and abs(span.end - 2.0) < 0.12


def test_floor_follows_noise_steps():
    down = track([np.r_[np.full(60, 0.04), np.full(120, 0.01)]])
    up = track([np.r_[np.full(60, 0.01), np.full(120, 0.02)]])
    assert not down[1][0].any() and down[0][0][-1] < 0.02
    assert not up[1][0].any() and up[0][0][-1] > 0.015


def first_numbers(dim: int):
    """A model of the test: the first numbers at unit length, silence as the first unit vector."""

    def model(clips: np.ndarray) -> np.ndarray:
        x = clips[:, :dim]
        lengths = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(lengths > 0, x / np.where(lengths > 0, lengths, 1.0), np.eye(1, dim))

    return lambda: model


def test_embedding_contract(spark):
    df = spark.createDataFrame([(i, [float(np.sin(i + k)) for k in range(64)]) for i in range(5)] + [(9, [0.0] * 64)], "id int, samples array<double>")
    rows = {r.id: np.array(r.embedding) for r in M.embed(df, first_numbers(16), 16).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in rows.values())
    assert rows[9].tolist() == [1.0] + [0.0] * 15
    with pytest.raises(Exception, match="expected"):
        M.embed(df, first_numbers(16), 8).collect()
    with pytest.raises(Exception, match="length 1"):
        M.embed(df, lambda: (lambda m: np.ones((len(m), 4))), 4).collect()


def test_recordings_json(spark, tmp_path):
    recs = [{"id": str(i), "q": "A" if i % 3 == 0 else ("" if i == 4 else "B"), "also": []} for i in range(25)]
    (tmp_path / "p1.json").write_text(json.dumps({"label": "crow", "page": 1, "recordings": recs[:15]}))
    (tmp_path / "p2.json").write_text(json.dumps({"label": "crow", "page": 2, "recordings": recs[15:]}))
    rows = D.read_recordings(spark, str(tmp_path))
    got = D.wanted_recordings(rows, "label", "q", [F.col("place")], 4, ["a"]).orderBy("rank").collect()
    assert [r.id for r in got] == ["0", "3", "4", "6"]


def test_manifest_json(spark, tmp_path):
    body = {"species_id": "crow", "recordings": {"7": {"file_path": "a.mp3", "quality": "A", "status": "cached"}}}
    (tmp_path / "metadata.json").write_text(json.dumps(body))
    assert [tuple(r) for r in D.read_manifest(spark, str(tmp_path)).collect()] == [("crow", "7", "a.mp3", "A", "cached")]


def test_bank_store(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, embedding array<double>")
    store = ST.BankStore(spark, str(tmp_path / "bank"))
    store.save(fit_bank(df))
    first = store.load(1).first()
    store.save(fit_bank(df.filter("label = 1").union(df.filter("label = 0").withColumn("label", F.lit(1)))))
    again = store.load(1).first()
    assert again.n_support == 2 and again.created_at == first.created_at and again.updated_at > first.updated_at
    store.delete([0])
    assert [r.label for r in store.labels().collect()] == [1]


def test_log_can_be_cleared_and_used_again(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"2024-01-0{i % 3 + 1} 10:00:00") for i in range(9)], "event_id long, t string")
    rows = rows.withColumn("t", F.to_timestamp("t"))
    log = ST.detections(rows, "event_id", F.lit("crow"), F.lit(0.9), F.lit("h"), 0.7, F.col("t"))
    ST.append_log(log, path)
    assert ST.clear_log(ST.read_log(spark, path), path) == 9
    assert ST.read_log(spark, path).count() == 0
    ST.append_log(log.filter("source_id < 4"), path)
    assert ST.read_log(spark, path).count() == 4


def test_replayed_batch_leaves_no_duplicates(spark, tmp_path):
    from vecmeadow.streaming import routes

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, embedding array<double>")
    store = ST.BankStore(spark, str(tmp_path / "bank"))
    store.save(fit_bank(df))
    queries = spark.createDataFrame([(5, [1.0, 0.1]), (6, [0.7, 0.7])], "vec_id long, embedding array<double>")

    class Sink:
        def foreachBatch(self, fn):
            self.fn = fn
            return self

    class Stream:
        writeStream = Sink()

    writer = routes.route(Stream(), store, 0.9, 0.01, str(tmp_path / "d"), str(tmp_path / "q"))
    for batch_id in (0, 0):
        writer.fn(queries, batch_id)
    assert sorted((r.vec_id, r.label) for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [(5, "0"), (6, "Unknown")]
    assert [r.vec_id for r in spark.read.parquet(str(tmp_path / "q")).collect()] == [6]


def test_names_and_taxa(spark):
    dim = C.species(spark)
    asked = spark.createDataFrame([("corvus_splendens",), (" CORVUS_splendens",), ("asian koel",), ("Pavo Cristatus",), ("dodo",)], "name string")
    got = {r.name: r.species_id for r in C.resolve_names(asked, dim).collect()}
    assert list(got.values()).count("corvus_splendens") == 2
    assert (got["asian koel"], got["Pavo Cristatus"], got["dodo"]) == ("eudynamys_scolopaceus", "pavo_cristatus", None)
    assert {t: C.in_taxon(dim, "taxon", t).count() for t in ("Bird", "insect", " frog ", "MAMMAL")} == {"Bird": 15, "insect": 8, " frog ": 5, "MAMMAL": 5}
    summary = {r.name: r.n for r in C.taxon_summary(dim).collect()}
    assert summary["bird"] == summary["Aves"] == 15 and summary["amphibian"] == 5


def test_vocabulary_match_equals_contains(spark):
    import random

    from vecmeadow.operators.report import vocabulary_matches

    rnd = random.Random(4)
    words = ["Koel", "crow", "a", "Ärger", "x1", "日本", "owl", "house-crow", "ii"]
    lines = [(j, rnd.choice([" ", ", ", "  "]).join(rnd.choices(words, k=rnd.randint(0, 12)))) for j in range(200)] + [(7, None), (None, "crow owl"), (3, "crow owl a")]
    names = [(i, n) for i, n in enumerate([
        "", None, "o", "OW", "owl", "crow owl", "w, o", "row ow", "KOEL crow a owl", "oel Crow ärger o", "nothing here", "house-crow", "日本", "ii ii",
        "crow owl", " ", ", ", "ouse-crow, house-cro", "x1 x1 x1 x", "日本 日本 a crow", "(crow", "l  crow  ",
    ])] + [(100 + k, lines[k * 9][1][2:30]) for k in range(20)]
    got = vocabulary_matches(
        spark.createDataFrame(names, "i long, n string"), spark.createDataFrame(lines, "j long, t string").repartition(3), "i", "n", "j", "t"
    ).collect()
    want = {}
    for i, n in names:
        held = [j for j, t in lines if n and t is not None and j is not None and n.lower() in t.lower()]
        want[i] = min(held, default=None)
    assert {r.i: r.first_line for r in got} == want and len(got) == len(names)
    assert all(r.in_vocabulary == (r.first_line is not None) for r in got)
    # One row for each of the many names of common words and none for those that no line has.
    assert sum(v is not None for v in want.values()) > 15 and None in want.values()


def test_vocabulary_match_stays_in_the_jvm(spark):
    from vecmeadow.operators.report import vocabulary_matches

    one = spark.createDataFrame([(1, "house crow owl")], "i long, n string")
    plan = vocabulary_matches(one, one, "i", "n", "i", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_vocabulary_match_of_nothing(spark):
    from vecmeadow.operators.report import vocabulary_matches

    none = spark.createDataFrame([], "i long, n string")
    one = spark.createDataFrame([(1, "house crow owl")], "i long, n string")
    assert vocabulary_matches(none, one, "i", "n", "i", "n").count() == 0
    assert [tuple(r) for r in vocabulary_matches(one, none, "i", "n", "i", "n").select("i", "first_line").collect()] == [(1, None)]
