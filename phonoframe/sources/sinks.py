"""Sinks: manifests, maps, transcripts, dictionaries, and versioned tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share, from spark.checkpoint.dir; it goes when the application ends.

    Where that is unset a temporary one is used, in local mode alone; a cluster has no folder that would do.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if top is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    place = f"{top.rstrip('/')}/phonoframe-{uuid.uuid4().hex}"
    path, fs = _path(spark, place)
    fs.deleteOnExit(path)
    return place


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, place: str) -> bool:
    path, fs = _path(spark, place)
    return fs.exists(path)


def children(spark: SparkSession, place: str) -> list[str]:
    """The names in a folder; none where it isn't there."""
    path, fs = _path(spark, place)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def remove(spark: SparkSession, place: str) -> None:
    path, fs = _path(spark, place)
    fs.delete(path, True)


def move(spark: SparkSession, names: list[str], place: str, to: str) -> None:
    """Folders of one place to another, over those that have their names there, without a copy."""
    path, (_, fs) = spark._jvm.org.apache.hadoop.fs.Path, _path(spark, place)
    for name in names:
        old = path(f"{to}/{name}")
        fs.delete(old, True)
        if not fs.rename(path(f"{place}/{name}"), old):
            raise OSError(f"{place}/{name} can't be moved to {to}")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What a query shuffled goes when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder, for what reads it several times."""
    return _stored(df, scratch(df.sparkSession))


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """As ``stored``, but only inside; nothing that is read afterwards may come of it."""
    path = scratch(df.sparkSession)
    try:
        yield _stored(df, path)
    finally:
        remove(df.sparkSession, path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows``, and aggregates of them that Spark takes while something else is made of them, for ``written``."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def written(rows: DataFrame, path: str, seen: Observation) -> DataFrame:
    """Write ``rows``; one row with what was observed on the way, so that nothing is read twice. The rows must come of the observed ones."""
    rows.write.mode("overwrite").parquet(path)
    got = seen.get
    return rows.sparkSession.createDataFrame([tuple(got.values())], T.StructType([T.StructField(name, T.LongType()) for name in got]))


def escaped(text: Column) -> Column:
    r"""\ | " and line feeds with a backslash before them."""
    return F.replace(F.regexp_replace(text, r'([\\|"])', r"\\$1"), F.lit("\n"), F.lit(r"\n"))


def write_pipe_manifest(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Text files of |-separated columns without quotes, each with a header line.

    Spark's CSV writer puts NUL bytes around such fields, hence the text writer.
    """
    line = rows.select(F.concat_ws("|", *[escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("value"))
    line.write.mode("overwrite").option("lineSep", "\n").text(path + "/rows")
    rows.sparkSession.createDataFrame([("|".join(columns),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/header")


def write_json_manifest(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in order within each file; null fields are left out."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_json_array(rows: DataFrame, path: str, order: list[str], most: int = 100_000) -> None:
    """One file with one JSON array in order, for small output: it is counted, and more than ``most`` rows are refused."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows belong into JSON lines")
    each = rows.select(F.struct(*order).alias("o"), F.to_json(F.struct(*rows.columns)).alias("j"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"])
    one = each.agg(F.concat(F.lit("[\n  "), F.array_join(lines, ",\n  "), F.lit("\n]")).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def vocabulary_json(vocabulary: DataFrame) -> DataFrame:
    """One row: the vocabulary's three sections as JSON, tokens by id; read again by ``vocabulary_of_json``."""
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "token")))), lambda x: x["token"])
    one = vocabulary.agg(listed("special").alias("special_tokens"), listed("phoneme").alias("phonemes"), listed("language").alias("languages"), F.count(F.lit(1)).alias("size"))
    return one.select(F.to_json(F.struct("special_tokens", "phonemes", "languages", "size")).alias("json"))


def vocabulary_of_json(rows: DataFrame) -> DataFrame:
    r = rows.select(F.from_json("json", "special_tokens array<string>, phonemes array<string>, languages array<string>").alias("r")).select("r.*")

    def section(column: str, kind: str) -> Column:
        return F.transform(column, lambda t: F.struct(t.alias("token"), F.lit(kind).alias("kind")))

    sections = F.concat(section("special_tokens", "special"), section("phonemes", "phoneme"), section("languages", "language"))
    return r.select(F.posexplode(sections).alias("id", "x")).select(F.col("id").cast("long").alias("id"), "x.token", "x.kind")


def speaker_json(speakers: DataFrame) -> DataFrame:
    """One row: code -> id as JSON, in order of ids."""
    return speakers.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "speaker_id"))))).alias("json"))


def write_transcripts(rows: DataFrame, path: str) -> None:
    """(speaker, audio_id, tokens): one folder a speaker with (audio_id, transcript); what was there goes."""
    transcripts(rows).write.mode("overwrite").partitionBy("speaker").parquet(path)


def transcripts(rows: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """(speaker, audio_id, transcript) of the rows with tokens, and with a file in ``audio`` (path, size) if that is given: its stem is the id."""
    if audio is not None:
        rows = rows.join(audio.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("audio_id")).distinct(), "audio_id", "left_semi")
    return rows.filter(F.size("tokens") > 0).select("speaker", "audio_id", F.concat_ws(" ", "tokens").alias("transcript"))


def transcript_counts(rows: DataFrame, made: DataFrame) -> DataFrame:
    """One row: total of the manifest, prepared of them, their speakers."""
    return rows.agg(F.count(F.lit(1)).alias("total")).crossJoin(made.agg(F.count(F.lit(1)).alias("prepared"), F.countDistinct("speaker").alias("speakers")))


def dictionary_lines(vocabulary: DataFrame) -> DataFrame:
    """(id, value): phone, tab, phone for each phoneme, in order of the vocabulary."""
    return vocabulary.filter("kind = 'phoneme'").select("id", F.concat_ws("\t", "token", "token").alias("value"))


#: Bytes, about, of a file that holds many small ones; each is read as a whole.
PACK_BYTES = 4 << 20


def write_packs(rows: DataFrame, path: str, name: str, content: str) -> None:
    """Many small files (name, content) in few larger ones, read again by ``readers.packed``: their number follows the bytes, not the names.

    A content with the separator, the character 3, or a name with that or the character 2 is refused.
    """
    size = rows.agg(F.sum(F.octet_length(content))).first()[0] or 0
    key, text = F.col(name).cast("string"), F.col(content)
    odd = text.contains("\x03") | key.contains("\x03") | key.contains("\x02")
    line = F.when(odd, F.raise_error(F.lit("a separator is in a packed file's name or content"))).otherwise(F.concat(key, F.lit("\x02"), text))
    packs = rows.select(F.pmod(F.xxhash64(name), F.lit(max(1, -(-size // PACK_BYTES)))).alias("pack"), line.alias("value"))
    packs.repartition("pack").write.mode("overwrite").partitionBy("pack").option("lineSep", "\x03").text(path)


def write_duration_records(clips: DataFrame, path: str, buckets: int = 16) -> None:
    """(audio_id, phones, durations, total_frames) in folders by a hash of the id, not one file a clip."""
    clips.withColumn("bucket", F.pmod(F.xxhash64("audio_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def swap(table: DataFrame, top: str) -> str:
    """Write a table as a new version below ``top`` and return its path; the version that was read stays untouched."""
    path = f"{top}/v-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path
