"""Labelled recordings: scan, container checks, PCM decoding, segments and their manifest."""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmeadow.functions import signal as G
from vecmeadow.functions.text import extension
from vecmeadow.functions.vectors import let


def scan(spark: SparkSession, root: str, least: int = 5, glob: str = "*.wav") -> DataFrame:
    """``<root>/<label>/<file>`` as ``label, path, length, content``, labels with at least ``least`` files.

    Spark's file scan leaves out files of zero bytes.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        .select(F.element_at(F.split("path", "/"), -2).alias("label"), "path", "length", "content")
    )
    return enough_files(files, least)


def enough_files(files: DataFrame, least: int, label: str = "label") -> DataFrame:
    """Only rows of labels with enough files; the count reads no file content."""
    big = files.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return files.join(big.select(label), label, "left_semi")


def reject_reason(content: Column, path: Column) -> Column:
    """Why a container is refused, or null. Only the first 12 bytes are looked at."""
    head = F.substring(content, 1, 12)
    size = F.octet_length(head)
    is_wav = extension(path) == ".wav"
    riff = F.hex(F.substring(head, 1, 4)) == "52494646"
    wave = F.hex(F.substring(head, 9, 4)) == "57415645"
    return (
        F.when(content.isNull(), "missing")
        .when(size == 0, "empty")
        .when(size < 4, "header too short")
        .when(is_wav & (size < 12), "truncated wav header")
        .when(is_wav & ~(riff & wave), "not RIFF/WAVE")
    )


def good_and_rejected(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = files.withColumn("reason", reject_reason(F.col("content"), F.col("path")))
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL").drop("content")


def pcm_samples(data: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and mono samples of a RIFF container with integer or float PCM."""
    at, layout, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            layout = struct.unpack_from("<HHIIHH", data, at + 8)
            if layout[0] == 0xFFFE and size >= 26:
                layout = (struct.unpack_from("<H", data, at + 32)[0], *layout[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if layout is None or body is None:
        raise ValueError("no fmt or data chunk")
    kind, channels, rate, _, _, bits = layout
    width = bits // 8
    if channels < 1 or width < 1:
        raise ValueError("bad format chunk")
    body = body[: len(body) // (width * channels) * width * channels]
    if kind == 3 and bits in (32, 64):
        values = np.frombuffer(body, dtype=f"<f{width}").astype(np.float32)
    elif kind == 1 and bits == 8:
        values = (np.frombuffer(body, dtype=np.uint8).astype(np.float32) - 128.0) / 128.0
    elif kind == 1 and bits in (16, 32):
        values = (np.frombuffer(body, dtype=f"<i{width}") / float(2 ** (bits - 1))).astype(np.float32)
    elif kind == 1 and bits == 24:
        raw = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        wide = np.zeros((len(raw), 4), dtype=np.uint8)
        wide[:, 1:] = raw
        values = (wide.view("<i4").reshape(-1) / float(2**31)).astype(np.float32)
    else:
        raise ValueError(f"unsupported format {kind} with {bits} bits")
    mono = values.reshape(-1, channels).mean(axis=1, dtype=np.float32)
    return rate, channels, np.nan_to_num(mono, nan=0.0, posinf=1.0, neginf=-1.0)


def decode(files: DataFrame) -> DataFrame:
    """Add ``rate, channels, samples, error``; a file that cannot be decoded has an error and null samples.

    One row at a time leaves the task, so a batch of long recordings is never
    held twice.
    """
    keep = [c for c in files.columns if c != "content"]
    schema = T.StructType(
        [files.schema[c] for c in keep]
        + [
            T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()),
            T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(batch.schema.get_field_index("content"))
            for i in range(batch.num_rows):
                try:
                    rate, channels, samples = pcm_samples(contents[i].as_py())
                    error = None if len(samples) else "no samples"
                except Exception as problem:
                    rate = channels = samples = None
                    error = str(problem)
                row = batch.slice(i, 1)
                found = pa.array([None if error else samples], type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [row.column(row.schema.get_field_index(c)) for c in keep]
                    + [pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), found, pa.array([error], pa.string())],
                    names=[*keep, "rate", "channels", "samples", "error"],
                )

    return files.mapInArrow(run, schema)


def segments(
    df: DataFrame, samples: str, n: int, hop: int, pad_tail: bool = False, tail_min: int = 0, least: int = 100
) -> DataFrame:
    """One row per segment of ``n`` samples: ``seg_idx, start, samples`` with the other columns kept."""
    starts = G.segment_starts(F.size(samples), n, hop, pad_tail, tail_min, least)
    keep = [c for c in df.columns if c != samples]
    cut = df.select(*keep, samples, F.posexplode(starts).alias("seg_idx", "start"))
    return cut.select(
        *keep, F.col("seg_idx").cast("long").alias("seg_idx"), F.col("start").cast("long").alias("start"),
        G.pad_right(F.slice(samples, F.col("start") + 1, n), n).alias(samples),
    )


class SegmentUdtf:
    """SQL form: ``SELECT s.* FROM t, LATERAL segment(samples, 144000, 144000, false, 14400, 100) s``."""

    def eval(self, samples, n, hop, pad_tail, tail_min, least):
        size = len(samples) if samples is not None else 0
        if size < least:
            return
        if size < n:
            yield 0, 0, list(samples) + [0.0] * (n - size)
            return
        index = 0
        while index * hop + n <= size:
            yield index, index * hop, list(samples[index * hop : index * hop + n])
            index += 1
        tail = samples[index * hop :]
        if pad_tail and len(tail) and len(tail) >= tail_min:
            yield index, index * hop, list(tail) + [0.0] * (n - len(tail))


def register_segment_udtf(spark: SparkSession, name: str = "segment") -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(SegmentUdtf, returnType="seg_idx long, start long, samples array<double>"))


def float_blob(v: Column) -> Column:
    """Numbers as little-endian float32 bytes."""

    def run(rows):
        return rows.map(lambda r: None if r is None else np.asarray(r, dtype="<f4").tobytes())

    return _pandas(run, "binary")(v)


def blob_floats(b: Column) -> Column:
    """Little-endian float32 bytes as numbers."""

    def run(rows):
        return rows.map(lambda r: None if r is None else np.frombuffer(r, dtype="<f4"))

    return _pandas(run, "array<float>")(b)


def _pandas(fn, returns):
    import pandas as pd

    fn.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(fn, returns)


def manifest(df: DataFrame, samples: str, rate: str) -> DataFrame:
    """Per segment: frames, duration, peak, rms and the hash of its float samples."""
    x = F.col(samples)
    rest = [c for c in df.columns if c != samples]
    return df.select(
        *rest, F.size(x).cast("long").alias("frames"), (F.size(x) / F.col(rate)).alias("duration"),
        G.peak(x).alias("peak"), F.sqrt(G.mean_square(x)).alias("rms"), F.sha2(float_blob(x), 256).alias("sha256"),
    )


def sample_statistics(df: DataFrame, samples: str) -> DataFrame:
    """The columns ``operators.audit.clip_audit`` looks at."""
    bad = lambda s: F.isnan(s) | (F.abs(s) == float("inf"))
    x = F.col(samples).cast("array<double>")
    return df.withColumns(
        {
            "frames": F.size(x), "lowest": F.array_min(x), "highest": F.array_max(x),
            "mean": F.aggregate(x, F.lit(0.0), lambda a, s: a + s) / F.size(x), "rms": let(x, lambda v: F.sqrt(G.mean_square(v))),
            "non_finite": F.size(F.filter(x, bad)),
        }
    )


def write_manifest(df: DataFrame, path: str) -> None:
    """One folder per label; labels are spread by path so that a large label is written by many tasks."""
    df.write.mode("overwrite").partitionBy("label").json(path)
