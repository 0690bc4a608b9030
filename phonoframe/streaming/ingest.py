"""Incremental ingest of crawled pages into a catalog of languages, recordings and entries, by file streams."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, extract, ranking
from ..sources import sinks

#: Each table's key, by whose hash its rows are dealt to buckets. ``pages`` has the digest of what was taken in last from each address.
KEYS = {"languages": ["code"], "recordings": ["language_code", "audio_filename"], "entries": ["wordlist_url"], "pages": ["url"]}
#: A table has about so many buckets for each root of its rows, so that a small batch rewrites little of a large table and its files stay few; of a small table so many rows are a bucket.
BUCKETS_PER_ROOT, LEAST_BUCKETS, LEAST_ROWS = 4, 8, 64
#: Up to so many buckets are named in the plan, so that the others aren't listed.
NAMED_BUCKETS = 2000


def buckets_for(rows: int) -> int:
    """A power of two that grows with the root of the rows."""
    rows = max(1, rows)
    return max(LEAST_BUCKETS, 2 ** round(math.log2(min(BUCKETS_PER_ROOT * math.sqrt(rows), rows / LEAST_ROWS))))


class Catalog:
    """Tables as Parquet partitioned by bucket, below a shared folder; a merge replaces the partitions that it changes.

    New rows of those buckets are written aside first and moved into place then; a run that ends before all are moved is taken up again by the next one that writes. One writer at a time.
    """

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top

    def _rows(self, table: str, buckets: int) -> str:
        return f"{self.top}/{table}/buckets={buckets}"

    def _aside(self, table: str) -> str:
        return f"{self.top}/{table}/aside"

    def buckets(self, table: str) -> int | None:
        """The table's number of buckets; none where it has no rows yet."""
        found = [f.removeprefix("buckets=") for f in sinks.children(self.spark, f"{self.top}/{table}") if f.startswith("buckets=")]
        whole = [int(n) for n in found if sinks.exists(self.spark, f"{self._rows(table, int(n))}/_SUCCESS")]
        return max(whole, default=None)

    def take_up(self, table: str) -> None:
        """For who writes: what was written aside and not put in place yet is put there; what wasn't written whole goes, and so does what a larger layout replaced."""
        aside, now = self._aside(table), self.buckets(table)
        if now is not None and sinks.exists(self.spark, f"{aside}/_SUCCESS"):
            self._put(table, now)
        sinks.remove(self.spark, aside)
        for f in sinks.children(self.spark, f"{self.top}/{table}"):
            if f.startswith("buckets=") and f != f"buckets={now}":
                sinks.remove(self.spark, f"{self.top}/{table}/{f}")

    def _put(self, table: str, buckets: int) -> None:
        found = [f for f in sinks.children(self.spark, self._aside(table)) if f.startswith("_bucket=")]
        sinks.move(self.spark, found, self._aside(table), self._rows(table, buckets))

    def read(self, table: str, touched: DataFrame | None = None) -> DataFrame | None:
        """The table, or only its buckets among ``touched`` (_bucket), with _bucket then."""
        now = self.buckets(table)
        if now is None:
            return None
        rows = self.spark.read.parquet(self._rows(table, now))
        if touched is None:
            return rows.drop("_bucket")
        named = [r[0] for r in touched.limit(NAMED_BUCKETS + 1).collect()]
        return rows.filter(F.col("_bucket").isin(named)) if len(named) <= NAMED_BUCKETS else rows.join(touched, "_bucket", "left_semi")

    def unchanged(self, pages: DataFrame) -> DataFrame:
        """The (url, sha256) among ``pages`` that were taken in last from their address."""
        now = self.buckets("pages")
        if now is None:
            return pages.select("url", "sha256").limit(0)
        touched = pages.select(_bucket(["url"], now).alias("_bucket")).distinct()
        return self.read("pages", touched).join(pages.select("url", "sha256"), ["url", "sha256"]).select("url", "sha256")

    def merge(self, table: str, new: DataFrame, put: Callable[[DataFrame | None, DataFrame], DataFrame], made: Callable[[], object] = lambda: None) -> None:
        """``put`` gets the old rows of the buckets that ``new`` falls into, and ``new``; other buckets stay as they are. ``made`` is called when ``new`` is stored and what it comes of may go."""
        with sinks.held(new) as new:
            made()
            n = new.count()
            if not n:
                return
            self.take_up(table)
            now = self.buckets(table)
            if now is None:
                return self._lay_out(table, put(None, new), buckets_for(n))
            with sinks.held(new.select(_bucket(KEYS[table], now).alias("_bucket")).distinct()) as touched:
                merged = put(self.read(table, touched).drop("_bucket"), new)
                merged.withColumn("_bucket", _bucket(KEYS[table], now)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self._aside(table))
                rows = self.spark.read.parquet(self._aside(table)).count() * now // touched.count()  # of the whole table, about
        self._put(table, now)
        sinks.remove(self.spark, self._aside(table))
        if buckets_for(rows) >= 4 * now:  # the table is sixteen times as large as when it was laid out
            self._lay_out(table, self.read(table), buckets_for(rows))
            sinks.remove(self.spark, self._rows(table, now))

    def _lay_out(self, table: str, rows: DataFrame, buckets: int) -> None:
        rows.withColumn("_bucket", _bucket(KEYS[table], buckets)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self._rows(table, buckets))


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def languages_of(pages: DataFrame) -> DataFrame:
    """(code, name, url) from the index pages among ``pages`` (url, html)."""
    base = pages.select(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("base"), F.col("url").alias("page_id"), "html")
    found = extract.links(base).join(base.select("page_id", "base"), "page_id")
    made = extract.language_index(found, "")
    code = F.upper(F.regexp_extract("href", r"(?i)^\.\./Language/([^/]+)/", 1))
    first = found.groupBy(code.alias("code")).agg(F.min("base").alias("base"))
    return made.join(first, "code").select("code", "name", F.concat("base", "url").alias("url"))


def recordings_of(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """Recordings with their language's code from the language pages ``pages`` (url), whose cells by url are ``cells``."""
    made = extract.recordings(cells.withColumnRenamed("url", "page_id"), pages.select(F.col("url").alias("page_id"), "url"))
    return made.select(F.upper(F.regexp_extract("page_id", LANGUAGE_PAGE, 1)).alias("language_code"), *[c for c in made.columns if c not in ("page_id", "row_idx")])


#: Addresses of the pages that list a language's recordings; pages that link to them by ../Language/ are indexes.
LANGUAGE_PAGE = r"(?i)/Language/([^/]+)/[^/]+\.html?$"


def ingest(spark: SparkSession, pages_dir: str, top: str, word_lists: str = r"(?i)word-list[^/]*\.html?(#.*)?$", files_per_batch: int = 4) -> Catalog:
    """Take in every page file (url, html) that is new below ``pages_dir`` and return the catalog.

    Of the pages with one address in a batch the last counts: by the file's time, then its path, then the place in it. A page whose digest is that of
    what was taken in last from its address is dropped before anything is parsed. Languages and recordings are upserted (recordings keep their ids), the entries of a word list are replaced; a word list without rows keeps what it had. Entries know
    their page, so that it doesn't matter whether its recording comes before or after. All of this gives the same tables if
    a batch is run again, as happens after a crash or where the stream's checkpoint is lost. Pages aren't stored once more: what counts is known by file
    and place, and is read again there; cells and entries go as soon as what comes of them is written.
    """
    store = Catalog(spark, top)
    for table in KEYS:
        store.take_up(table)
    schema = spark.read.parquet(pages_dir).schema

    def recordings(old: DataFrame | None, new: DataFrame) -> DataFrame:
        known = store.read("recordings")
        none = new.limit(0).select(F.lit(None).cast("long").alias("recording_id"), "*")
        return catalog.upsert_recordings(none if old is None else old, new, known=none if known is None else known)

    def batch(pages: DataFrame, number: int) -> None:
        order = F.struct("_time", "_path", "_index")
        digest = F.sha2(F.coalesce("html", F.lit("")), 256)  # a page without content is as an empty one
        latest = sinks.stored(pages.filter("url is not null").groupBy("url").agg(F.max_by(F.struct("_path", "_index", digest.alias("sha256")), order).alias("x")).select("url", "x.*"))
        known = ranking.small(sinks.stored(store.unchanged(latest)))
        latest = sinks.stored(latest.join(known, ["url", "sha256"], "left_anti"))
        markup = lambda which: pages.select("_path", "_index", "html").join(ranking.small(latest.filter(which).select("url", "_path", "_index")), ["_path", "_index"]).select("url", "html")
        is_list = F.col("url").rlike(word_lists)
        is_language = F.col("url").rlike(LANGUAGE_PAGE) & ~is_list
        kinds = latest.agg(F.count(F.lit(1)).alias("pages"), F.count_if(is_list).alias("lists"), F.count_if(is_language).alias("languages")).head()
        if not kinds["pages"]:
            return
        if kinds["pages"] > kinds["lists"] + kinds["languages"]:
            with sinks.held(markup(~is_list & ~is_language)) as indexes:
                store.merge("languages", languages_of(indexes), lambda old, new: new if old is None else catalog.upsert(old, new, ["code"]))
        if kinds["languages"]:
            with sinks.held(extract.cells(markup(is_language), "url")) as cells:
                store.merge("recordings", recordings_of(latest.filter(is_language), cells), recordings)
        if kinds["lists"]:
            with ExitStack() as made:
                pages_of_lists = markup(is_list).repartition("url").withColumn("wordlist_url", F.regexp_replace("url", "#.*$", ""))
                cells = made.enter_context(sinks.held(extract.cells(pages_of_lists, "wordlist_url")))
                store.merge("entries", extract.entries(cells, "wordlist_url"), lambda old, new: new if old is None else catalog.replace_of(old, new, "wordlist_url"), made.close)
        # last, so that a batch which ended early is parsed again
        store.merge("pages", latest.select("url", "sha256"), lambda old, new: new if old is None else catalog.upsert(old, new, ["url"]))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pages_dir)
    stream = stream.select("url", "html", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    with sinks.shuffles_go(spark):
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{top}/stream").trigger(availableNow=True).start().awaitTermination()
    return store


def exported(store: Catalog) -> DataFrame:
    """Every entry of the catalog beside its recording and language."""
    r = store.read("recordings").withColumn("wordlist_url", F.regexp_replace("wordlist_url", "#.*$", ""))
    languages = store.read("languages").select(F.col("code").alias("language_code"), F.col("name").alias("language_name"))
    r = r.select("wordlist_url", "recording_id", "language_code", "audio_filename", "year", "sequence").join(languages, "language_code", "left")
    return store.read("entries").join(r, "wordlist_url")
