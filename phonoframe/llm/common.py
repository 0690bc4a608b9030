"""What the corpus operators share: stored cuts of the lineage, salts, hashing of texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: A salt is one of so many values, so that a set of salts fits the bits of a long.
SALTS = 64
#: Bytes of text, about, that a task holds as Python objects at once; one text at least.
TEXT_BYTES = 2 << 20

def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset a temporary folder is set, in local mode alone; a cluster has no folder that would do.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def new_table(spark: SparkSession) -> str:
    """A new place in the shared folder, which goes when the application ends."""
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


def remove_table(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Few rows at once go to Python, so that executors hold few whole texts outside Spark's heap.
ROWS_TO_PYTHON = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: How cuts run: shuffle files go as soon as a cut is written, and few rows at once go to Python.
CUT_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ROWS_TO_PYTHON
#: So many rows of a small side may be broadcast; more are joined.
MOST_BROADCAST = 500_000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside alone."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut(df: DataFrame, rows_to_python: int | None = None) -> DataFrame:
    """``df`` as a table written in the shared folder: cuts the lineage, and its shuffles need not be kept."""
    spark = df.sparkSession
    place = new_table(spark)
    more = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows_to_python)} if rows_to_python else {}
    with settings(spark, CUT_SETTINGS | more):
        df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has MOST_BROADCAST rows at most."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def over_texts(returns: str, start: Callable[[], Callable[[list[str]], list]]) -> Callable[..., Column]:
    """A Spark function of a whole text. ``start`` gives a task its function from a list of texts to as many results.

    Arrow batches are cut to about TEXT_BYTES of text, and what they took is given back after each, so that a task's
    memory follows its longest text alone.
    """
    kind = to_arrow_type(DataType.fromDDL(returns))

    @F.arrow_udf(returns)
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for texts in parts:
            cuts = slices(pc.binary_length(texts).to_pylist(), TEXT_BYTES)
            done = [pa.array(work(texts.slice(a, b - a).to_pylist()), kind) for a, b in cuts]
            yield pa.concat_arrays(done) if done else pa.array([], kind)
            del texts, done
            give_back()

    return of


def text_slices(parts: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of whole texts for mapInArrow, cut as in ``over_texts``."""
    for batch in parts:
        for a, b in slices(pc.binary_length(batch.column(text)).to_pylist(), TEXT_BYTES):
            yield batch.slice(a, b - a)
        del batch
        give_back()


def give_back() -> None:
    """Free memory that this process holds goes back to the system, where its allocator can do that."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns_of(df: DataFrame, *less: str) -> list[Column]:
    """The columns of ``df`` whatever their names are, without some."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in less]


def with_rows(df: DataFrame) -> DataFrame:
    """(row long, doc struct): the rows of ``df``, each named by its file's number, in order of paths, and its place there.

    Reading again gives the same names. What doesn't come from files is stored first. Columns of any name fit into ``doc``.
    """
    def placed(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc") if df.columns == ["doc"] else F.struct(*columns_of(df)).alias("doc"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))

    try:
        if "_metadata" in map(str.lower, df.columns):
            raise AnalysisException("a column hides the place of the rows")
        rows = placed(df)
    except AnalysisException:
        rows = placed(cut(df.select(F.struct(*columns_of(df)).alias("doc"))))
    number = F.row_number().over(W.Window.orderBy("path")).cast("long")  # over files, which are few
    files = small(cut(rows.select("path").distinct().withColumn("file", number)))
    return rows.join(files, "path").select(F.call_function("shiftleft", F.col("file"), F.lit(40)).bitwiseOR(F.col("at")).alias("row"), "doc")


def salt(*cols: str) -> Column:
    """A number from 0 to SALTS - 1 that depends on the row alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salts_seen(s: Column) -> Column:
    """Aggregate: the set of the salts of a group, as the bits of a long."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), s))


def each_salt(mask: Column) -> Column:
    """One row for each salt in the set."""
    bits = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return F.explode(F.filter(bits, lambda i: F.call_function("shiftrightunsigned", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1))


def whole(text: str = "text") -> Column:
    """The text; empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a run of sizes into (from, to) pieces of about ``limit`` in sum, one item at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
