"""Sources: pages, corpora, manifests, alignments, logs, file listings, waveforms."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: frame length of waveforms in milliseconds.
FRAME_MS = 10
#: Frames of a waveform that a task holds as numbers.
FRAMES_AT_ONCE = 60_000


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html, error): a page that can't be used has an error and doesn't end the job."""
    rows = spark.read.parquet(path)
    error = F.when(F.col("html").isNull(), "no content").when(F.trim("html") == "", "empty").when(~F.col("html").contains("<"), "no markup")
    return rows.withColumn("error", error)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unescaped(text: Column) -> Column:
    r"""\n, \|, \" and \\ as the characters they stand for."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(r"\\"), F.lit("\0")), r"\\n", "\n"), r'\\([|"])', "$1"), F.lit("\0"), F.lit("\\"))


def pipe_manifest(spark: SparkSession, path: str, columns: list[str], unescape: bool = True) -> DataFrame:
    """A text manifest of |-separated columns with a header line; escapes are undone unless told otherwise.

    Spark's CSV reader splits at escaped separators, hence the text reader.
    """
    lines = spark.read.text(path).filter(F.col("value") != "|".join(columns))
    # a field is made of other characters and of escaped ones, taken for good, so that long ones need no stack; what follows the last is no field
    parts = F.regexp_extract_all("value", F.lit(r"((?:[^|\\]++|\\.)*+)(\||$)"), F.lit(1)) if unescape else F.split("value", r"\|")
    part = lambda i: unescaped(F.get(parts, i)) if unescape else F.get(parts, i)
    return lines.select(*[part(i).alias(c) for i, c in enumerate(columns)])


def json_manifest(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """Rows of a JSON manifest: lines, or one array; a missing text is empty, a missing code UNK, a missing name the code."""
    rows = spark.read.option("multiLine", array).schema(schema).json(path)
    code = F.coalesce("language_code", F.lit("UNK"))
    return rows.withColumns({"ipa": F.coalesce("ipa", F.lit("")), "language_code": code, "language_name": F.coalesce("language_name", code)})


def whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content): every file below a folder whose name fits."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return found.select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def packed(spark: SparkSession, path: str) -> DataFrame:
    """(name string, content) of the small files that ``sinks.write_packs`` put into few."""
    each = whole_files(spark, path, "*.txt").select(F.explode(F.split("content", "\x03")).alias("x")).filter("x <> ''")
    parts = F.split("x", "\x02", 2)
    return each.select(parts[0].alias("name"), parts[1].alias("content"))


def log_lines(files: DataFrame) -> DataFrame:
    """(run, line_no, line) of (run, content), without colour codes."""
    clean = F.regexp_replace("content", r"\x1b\[[0-9;]*m", "")
    return files.select("run", F.posexplode(F.split(clean, r"\r?\n")).alias("line_no", "line"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size) of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("size"))


def pcm_frames(files: DataFrame, key: str = "rec_id", content: str = "content", frame_ms: int = FRAME_MS) -> DataFrame:
    """(key, frame_idx, t_ms, mean_sq, peak) of 16-bit WAV contents; one row with frame_idx -1 for what can't be read.

    Channels are averaged. Levels are shares of full scale. A long file is worked on FRAMES_AT_ONCE frames at a time.
    """

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k, data in zip(pdf[key], pdf[content], strict=True):
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        if w.getsampwidth() != 2:
                            raise wave.Error("16-bit samples are needed")
                        size, n = max(1, w.getframerate() * frame_ms // 1000), w.getnchannels()
                        for block in range(0, w.getnframes(), size * FRAMES_AT_ONCE):
                            x = np.frombuffer(w.readframes(size * FRAMES_AT_ONCE), "<i2").reshape(-1, n).mean(axis=1) / 32768
                            starts = np.arange(0, len(x), size)
                            if len(starts):
                                idx = np.arange(len(starts)) + block // size
                                yield pd.DataFrame({key: k, "frame_idx": idx, "t_ms": idx * frame_ms, "mean_sq": np.add.reduceat(np.square(x), starts) / np.diff(np.append(starts, len(x))), "peak": np.maximum.reduceat(np.abs(x), starts)})
                except (wave.Error, EOFError, TypeError, ValueError):
                    yield pd.DataFrame({key: [k], "frame_idx": [-1], "t_ms": [0], "mean_sq": [0.0], "peak": [0.0]})

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(frames, f"{key} {kind}, frame_idx long, t_ms long, mean_sq double, peak double")


def pcm_clips(regions: DataFrame, content: str = "content") -> DataFrame:
    """(segment_key, start_ms, end_ms, pcm): the samples of each region (segment_key, start_ms, end_ms, content); null where the file can't be read."""

    def slices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for key, a, b, data in zip(pdf["segment_key"], pdf["start_ms"], pdf["end_ms"], pdf[content], strict=True):
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        first, last = (min(w.getnframes(), max(0, int(t)) * w.getframerate() // 1000) for t in (a, b))
                        w.setpos(first)
                        pcm = w.readframes(max(0, last - first))
                except (wave.Error, EOFError, TypeError, ValueError):
                    pcm = None
                out.append((key, a, b, pcm))
            yield pd.DataFrame(out, columns=["segment_key", "start_ms", "end_ms", "pcm"])

    return regions.select("segment_key", "start_ms", "end_ms", content).mapInPandas(slices, "segment_key string, start_ms long, end_ms long, pcm binary")


@F.pandas_udf(T.BinaryType())
def wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """A mono WAV file of float samples in [-1, 1]."""
    out = []
    for x, r in zip(samples, rate, strict=True):
        with io.BytesIO() as f:
            with wave.open(f, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(int(r))
                w.writeframes(np.clip(np.round(np.asarray(x, float) * 32767), -32768, 32767).astype("<i2").tobytes())
            out.append(f.getvalue())
    return pd.Series(out)
