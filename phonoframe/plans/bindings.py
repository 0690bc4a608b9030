"""The library's tables as they are read out of the driver's, in Spark and as SQL.

A document is an entry, (language, source) a recording, a label a clip that was kept.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each (language, source): an aggregate, so that numbering it is no bottleneck."""
    pairs = table(spark, sf_dir, "documents").groupBy(F.upper("lang").alias("language_code"), F.col("source")).agg(F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(W.Window.orderBy("language_code", "source")).cast("long")
    name = F.concat(F.lower("language_code"), F.lit("_word-list_2009_"), F.format_string("%02d", (number % 100).cast("int")))
    r = pairs.withColumn("recording_id", number).withColumn("audio_filename", F.concat(name, F.lit("_"), "source"))
    return r.select(
        "recording_id", "language_code", "source", F.when(number % 5 == 0, "story").otherwise("word-list").alias("recording_type"), F.lit(2009).alias("year"), "audio_filename",
        F.when(number % 7 != 0, F.concat(F.lit("http://archive.example.org/"), "audio_filename", F.lit(".wav"))).alias("wav_url"),
        F.when(number % 4 != 0, F.concat(F.lit("http://archive.example.org/"), "audio_filename", F.lit(".html"), F.when(number % 6 == 0, "#top").otherwise(""))).alias("wordlist_url"),
        (number % 3 != 0).alias("downloaded"), F.col("n").alias("n_entries"),
    )


RECORDINGS = """
  select recording_id, language_code, source, case when recording_id % 5 = 0 then 'story' else 'word-list' end as recording_type, 2009 as year, audio_filename,
    case when recording_id % 7 <> 0 then 'http://archive.example.org/' || audio_filename || '.wav' end as wav_url,
    case when recording_id % 4 <> 0 then 'http://archive.example.org/' || audio_filename || '.html' || case when recording_id % 6 = 0 then '#top' else '' end end as wordlist_url,
    recording_id % 3 <> 0 as downloaded, n_entries
  from (select *, lower(language_code) || '_word-list_2009_' || lpad((recording_id % 100)::varchar, 2, '0') || '_' || source as audio_filename
    from (select row_number() over (order by upper(lang), source) as recording_id, upper(lang) as language_code, source, count(*) as n_entries from documents group by upper(lang), source))"""


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "documents").select(F.upper("lang").alias("code")).distinct()
    return codes.select("code", F.concat(F.lit("Language "), "code").alias("name"), F.concat(F.lit("http://archive.example.org/Language/"), "code", F.lit("/"), F.lower("code"), F.lit(".html")).alias("url"))


LANGUAGES = "select distinct upper(lang) as code, 'Language ' || upper(lang) as name, 'http://archive.example.org/Language/' || upper(lang) || '/' || lower(lang) || '.html' as url from documents"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries by their own numbers; every 97th has none, every 50th no text."""
    r = recordings(spark, sf_dir).select("recording_id", "language_code", "source")
    d = table(spark, sf_dir, "documents").withColumn("language_code", F.upper("lang"))
    d = d.join(r, ["language_code", "source"])
    return d.select(
        F.col("doc_id").alias("entry_id"), "recording_id", "language_code", F.concat(F.lit("Language "), "language_code").alias("language_name"),
        F.when(F.col("doc_id") % 97 != 0, F.col("doc_id")).cast("int").alias("entry_number"),
        F.when(F.col("doc_id") % 50 != 7, F.col("text")).alias("ipa"), F.concat(F.lit("gloss "), F.col("doc_id")).alias("english"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("").alias("orthography"),
    )


ENTRIES = f"""
  select doc_id as entry_id, recording_id, language_code, 'Language ' || language_code as language_name,
    case when doc_id % 97 <> 0 then doc_id::int end as entry_number,
    case when doc_id % 50 <> 7 then text end as ipa, 'gloss ' || doc_id as english, case when doc_id % 3 = 0 then d.source else '' end as orthography
  from documents d join ({RECORDINGS}) r on upper(d.lang) = r.language_code and d.source = r.source"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an entry with its whole text, for token reports."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.upper("lang").alias("language_code"), F.concat(F.lit("Language "), F.upper("lang")).alias("language_name"), F.col("text").alias("ipa"))


#: The decomposition of Latin letters with marks as nested replacements; DuckDB has no NFD.
_MARKED = [chr(i) for i in [*range(0xC0, 0x180), *range(0x1E00, 0x1F00)] if unicodedata.normalize("NFD", chr(i)) != chr(i)]


def sql_normalized(text: str) -> str:
    out = text
    for c in "[]/()":
        out = f"replace({out}, '{c}', '')"
    used = [c for c in _MARKED if c in "èéêçÉÈÊößäüÄÖóíñÇÓÑÍÜàáâãåëìîïòôõùúûýÿÀÁÂÃÅËÌÎÏÒÔÕÙÚÛÝ"]
    for c in used:
        out = f"replace({out}, '{c}', '{unicodedata.normalize('NFD', c)}')"
    for a, b in zip("g:'͜", "ɡːˈ͡", strict=True):
        out = f"replace({out}, '{a * 2 if a == chr(39) else a}', '{b}')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


#: The token grammar without tie bars, which these texts don't have.
SQL_TOKEN = r"[\p{L}\p{So}\p{Nd}]\p{M}*[ʰ-ˇˉ-ˋˍ-ˏ˒-˿]*|[ˈˌ]|[ːˑ]|[.]|\p{M}+|(?s:.)"


def sql_tokens(text: str) -> str:
    return f"[x for x in regexp_extract_all({sql_normalized(text)}, '{SQL_TOKEN}') if not regexp_full_match(x, '\\s+')]"


BY_LANGUAGE = f"select language_code, token, count(*) as count from (select upper(lang) as language_code, unnest({sql_tokens('text')}) as token from documents) group by all"
TOTALS = f"select token, sum(count)::bigint as count from ({BY_LANGUAGE}) group by token"
