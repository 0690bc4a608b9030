"""Queries on manifests: sources (S), sinks (K), filters (P), joins (J), splits (X) and the catalog (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ipa
from ..operators import catalog, filters, manifest, splits, vocab
from ..sources import readers, sinks
from . import bindings as b
from . import text_queries as t

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- documents as a corpus of clips: their sizes stand for milliseconds

CORPUS = """select doc_id as audio_id, text as ipa_audio_universal, lang as locale, 'audio_' || doc_id || '.mp3' as audio_file,
  case when doc_id % 50 = 7 then 'abc' when doc_id % 50 = 8 then null else n_chars::varchar end as duration_ms,
  case doc_id % 10 when 0 then 'dev' when 1 then 'test' when 2 then null else 'train' end as split from documents"""


def corpus(spark, sf):
    d = b.table(spark, sf, "documents")
    duration = F.when(F.col("doc_id") % 50 == 7, "abc").when(F.col("doc_id") % 50 != 8, F.col("n_chars").cast("string"))
    split = F.when(F.col("doc_id") % 10 == 0, "dev").when(F.col("doc_id") % 10 == 1, "test").when(F.col("doc_id") % 10 != 2, "train")
    return d.select(F.col("doc_id").alias("audio_id"), F.col("text").alias("ipa_audio_universal"), F.col("lang").alias("locale"), F.concat(F.lit("audio_"), "doc_id", F.lit(".mp3")).alias("audio_file"), duration.alias("duration_ms"), split.alias("split"))


#: Labels as clips that were cut: entries with a label have a segment.
SEGMENTS = f"select e.entry_id, e.recording_id, case when e.entry_id % 11 <> 0 then 'segments/' || e.entry_id || '.wav' end as segment_file, e.entry_id * 10 as start_ms, e.entry_id * 10 + 500 as end_ms from ({b.ENTRIES}) e semi join labels l on l.doc_id = e.entry_id"


def segments(spark, sf):
    labels = b.table(spark, sf, "labels").select(F.col("doc_id").alias("entry_id")).distinct()
    e = b.entries(spark, sf).join(labels, "entry_id", "left_semi")
    return e.select("entry_id", "recording_id", F.when(F.col("entry_id") % 11 != 0, F.format_string("segments/%d.wav", "entry_id")).alias("segment_file"), (F.col("entry_id") * 10).alias("start_ms"), (F.col("entry_id") * 10 + 500).alias("end_ms"))


# -- S and P

USABLE = "coalesce(split in ('train', 'dev'), false)"
IN_TIME = "coalesce(try_cast(coalesce(duration_ms, '0') as double) / 1000 between 0.3 and 15, false)"


@query("s1_pages", "select page_id, url, length(html)::int as size, case when html is null then 'no content' when trim(html) = '' then 'empty' when not contains(html, '<') then 'no markup' end as error from pages")
def s1(spark, sf):
    return readers.pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("size"), "error")


@query("s2_corpus_steps", f"select count(*) as loaded, count_if({USABLE})::bigint as in_split, count_if({USABLE} and ipa_audio_universal <> '')::bigint as transcribed, count_if({USABLE} and ipa_audio_universal <> '' and {IN_TIME})::bigint as in_duration from ({CORPUS})")
def s2(spark, sf):
    return filters.load_corpus(corpus(spark, sf), ["train", "dev"])[1]


@query("s2_written_steps", SQL["s2_corpus_steps"])
def s2w(spark, sf):
    """The same, counted while the usable rows are written."""
    return filters.write_corpus(corpus(spark, sf), ["train", "dev"], sinks.scratch(spark))


@query("p2_split", f"select audio_id, split from ({CORPUS}) where {USABLE}")
def p2(spark, sf):
    return corpus(spark, sf).filter(filters.in_splits(["train", "dev"])).select("audio_id", "split")


@query("p1_transcribed", f"select entry_id, recording_id from ({b.ENTRIES}) where ipa is not null and ipa <> ''")
def p1(spark, sf):
    return b.entries(spark, sf).filter(filters.transcribed()).select("entry_id", "recording_id")


@query("p3_duration", f"select audio_id, duration_ms from ({CORPUS}) where {IN_TIME}")
def p3(spark, sf):
    return corpus(spark, sf).filter(filters.in_duration()).select("audio_id", "duration_ms")


@query("p4_text_length", "select conv_id, turn from conversations where length(text) >= 3")
def p4(spark, sf):
    return b.table(spark, sf, "conversations").filter(filters.long_enough()).select("conv_id", "turn")


@query("p5_has_tokens", f"select conv_id, turn, len(t)::int as n_tokens from (select conv_id, turn, {b.sql_tokens('text')} as t from conversations) where len(t) > 0")
def p5(spark, sf):
    return filters.with_tokens(b.table(spark, sf, "conversations")).select("conv_id", "turn", F.size("tokens").alias("n_tokens"))


@query("p6_plausibility", f"""
  select coalesce(reason, 'kept') as reason, count(*) as clips from (select case when d is null then 'audio_error' when n < 3 then 'ipa_too_short' when d < n * 0.9 then 'too_short' when d > n * 1.05 then 'too_long' end as reason
  from (select try_cast(duration_ms as double) as d, len(regexp_replace(ipa_audio_universal, '\\s+', '', 'g')) * 1.2 as n from ({CORPUS}))) group by 1""")
def p6(spark, sf):
    rows = corpus(spark, sf).withColumn("d", F.col("duration_ms").try_cast("double")).withColumn("text", ipa.join_phones(F.col("ipa_audio_universal")))
    reason = filters.plausibility(F.col("d"), F.col("text"), 0.9 * 1.2, 1.05 * 1.2, 3)
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("clips"))


# -- S and K: round trips through files

#: The first turns of some conversations are of 50,000 characters and more.
TURNS = "select 'wavs/' || conv_id || '_' || turn || '.wav' as audio_file, replace(case when turn = 0 and conv_id % 50 = 1 and text <> '' then repeat(text, 1 + 50000 // length(text)) else text end, 'a', case turn % 3 when 0 then '|' when 1 then '\\' else '\"' end) as text, role as speaker_name from conversations"


def turns(spark, sf):
    c = b.table(spark, sf, "conversations")
    odd = F.when(F.col("turn") % 3 == 0, "|").when(F.col("turn") % 3 == 1, "\\").otherwise('"')
    long = (F.col("turn") == 0) & (F.col("conv_id") % 50 == 1) & (F.col("text") != "")
    text = F.when(long, F.repeat("text", (1 + F.floor(50000 / F.length("text"))).cast("int"))).otherwise(F.col("text"))
    return c.select(F.format_string("wavs/%d_%d.wav", "conv_id", "turn").alias("audio_file"), F.replace(text, F.lit("a"), odd).alias("text"), F.col("role").alias("speaker_name"))


COLUMNS = ["audio_file", "text", "speaker_name"]


@query("s3_k1_pipe_manifest", TURNS)
def s3(spark, sf):
    path = sinks.scratch(spark)
    sinks.write_pipe_manifest(turns(spark, sf), path, COLUMNS)
    return readers.pipe_manifest(spark, path + "/*", COLUMNS)


@query("k1_pipe_lines", f"""
  select audio_file || '|' || replace(replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), '"', '\\"'), chr(10), '\\n') || '|' || speaker_name as value from ({TURNS})
  union all select 'audio_file|text|speaker_name'""")
def k1(spark, sf):
    path = sinks.scratch(spark)
    sinks.write_pipe_manifest(turns(spark, sf), path, COLUMNS)
    return spark.read.text(path + "/*")


EXPORT = f"""
  select lower(e.language_code) || '_' || case when coalesce(entry_number, 0) < 1000 then lpad(coalesce(entry_number, 0)::varchar, 3, '0') else entry_number::varchar end as id, e.language_code, l.name as language_name, e.entry_id, e.entry_number, ipa, english,
    coalesce(segment_file, 'data/audio/' || e.language_code || '/' || audio_filename || '.wav') as audio_path, start_ms, end_ms, case when orthography <> '' then orthography end as orthography
  from ({b.ENTRIES}) e join ({b.RECORDINGS}) r using (recording_id) join ({b.LANGUAGES}) l on l.code = e.language_code left join ({SEGMENTS}) s on s.entry_id = e.entry_id where ipa is not null and ipa <> ''"""


def export(spark, sf):
    return manifest.export(b.entries(spark, sf), b.recordings(spark, sf), b.languages(spark, sf), segments(spark, sf))


@query("s4_k2_json_manifest", f"select id, case when entry_id % 13 = 0 then 'UNK' else language_code end as language_code, case when entry_id % 13 = 0 then 'UNK' else language_name end as language_name, entry_id, sha256(ipa) as ipa_sha256, audio_path, orthography from ({EXPORT})")
def s4(spark, sf):
    rows = export(spark, sf)
    for c in ("language_code", "language_name"):
        rows = rows.withColumn(c, F.when(F.col("entry_id") % 13 != 0, F.col(c)))
    path = sinks.scratch(spark)
    sinks.write_json_manifest(rows, path, ["language_code", "entry_number"])
    back = readers.json_manifest(spark, path, "id string, language_code string, language_name string, entry_id long, ipa string, audio_path string, orthography string")
    return back.select("id", "language_code", "language_name", "entry_id", F.sha2("ipa", 256).alias("ipa_sha256"), "audio_path", "orthography")


@query("k2_json_array", f"select code as language_code, name as language_name, url as ipa from ({b.LANGUAGES})")
def k2(spark, sf):
    """One array in one file, as languages are few."""
    path = sinks.scratch(spark)
    sinks.write_json_array(b.languages(spark, sf).toDF("language_code", "language_name", "ipa"), path, ["language_code"])
    return readers.json_manifest(spark, path, "language_code string, language_name string, ipa string", array=True)


@query("k3_vocabulary", t.VOCABULARY)
def k3(spark, sf):
    path = sinks.scratch(spark)
    sinks.vocabulary_json(t.vocabulary(spark, sf)).write.text(path)
    return sinks.vocabulary_of_json(spark.read.text(path).withColumnRenamed("value", "json"))


@query("k4_speaker_map", f"select '{{' || string_agg('\"' || code || '\":' || n, ',' order by code) || '}}' as json from (select code, row_number() over (order by code) - 1 as n from ({t.CODES}))")
def k4(spark, sf):
    return sinks.speaker_json(vocab.speaker_map(t.codes(spark, sf), "code"))


@query("k5_transcripts", f"select role as speaker, conv_id || '_' || turn as audio_id, array_to_string(t, ' ') as transcript from (select role, conv_id, turn, {b.sql_tokens('text')} as t from conversations) where len(t) > 0")
def k5(spark, sf):
    path = sinks.scratch(spark)
    rows = b.table(spark, sf, "conversations").select(F.col("role").alias("speaker"), F.concat_ws("_", "conv_id", "turn").alias("audio_id"), ipa.tokenize(F.col("text")).alias("tokens"))
    sinks.write_transcripts(rows, path)
    return spark.read.parquet(path).select("speaker", "audio_id", "transcript")


PREPARED = f"select role, conv_id, turn, len({b.sql_tokens('text')}) > 0 and turn % 4 <> 3 as ok from conversations"


@query("k5_transcript_counts", f"select count(*) as total, count_if(ok)::bigint as prepared, count(distinct role) filter (ok) as speakers from ({PREPARED})")
def k5c(spark, sf):
    """Every fourth turn has no audio."""
    c = b.table(spark, sf, "conversations")
    rows = c.select(F.col("role").alias("speaker"), F.concat_ws("_", "conv_id", "turn").alias("audio_id"), ipa.tokenize(F.col("text")).alias("tokens"))
    audio = c.filter("turn % 4 <> 3").select(F.format_string("data/wavs/%d_%d.wav", "conv_id", "turn").alias("path"), F.lit(1).alias("size"))
    return sinks.transcript_counts(rows, sinks.transcripts(rows, audio))


@query("k6_dictionary", f"select token || chr(9) || token as value from ({t.VOCABULARY}) where kind = 'phoneme'")
def k6(spark, sf):
    path = sinks.scratch(spark)
    sinks.dictionary_lines(t.vocabulary(spark, sf)).orderBy("id").select("value").write.text(path)
    return spark.read.text(path)


@query("s7_listing", "select count(distinct role) as files, count(*) > 0 as read from conversations")
def s7(spark, sf):
    path = sinks.scratch(spark)
    b.table(spark, sf, "conversations").select("role", "text").repartition("role").write.partitionBy("role").parquet(path)
    found = readers.listing(spark, path, "part-*")
    return found.agg(F.countDistinct(F.regexp_extract("path", "role=([^/]+)/", 1)).alias("files"), (F.count(F.lit(1)) > 0).alias("read"))


# -- J

@query("j1_export", f"select * replace (sha256(ipa) as ipa) from ({EXPORT})")
def j1(spark, sf):
    return export(spark, sf).withColumn("ipa", F.sha2("ipa", 256))


KEYED = f"""select audio_filename || '_' || case when coalesce(entry_number, 0) < 1000 then lpad(coalesce(entry_number, 0)::varchar, 3, '0') else entry_number::varchar end as segment_key, e.language_code, segment_file, ipa, audio_filename, entry_number, e.entry_id
  from ({SEGMENTS}) s join ({b.ENTRIES}) e using (entry_id) join ({b.RECORDINGS}) r on r.recording_id = e.recording_id where segment_file is not null and ipa is not null and ipa <> ''"""
TRAINING = f"select segment_key, language_code, segment_file, ipa from ({KEYED}) qualify row_number() over (partition by segment_key order by language_code desc, audio_filename desc, entry_number desc nulls last, entry_id desc) = 1"


def training(spark, sf):
    return manifest.training_segments(segments(spark, sf), b.entries(spark, sf), b.recordings(spark, sf))


@query("j2_training_segments", f"select * replace (sha256(ipa) as ipa) from ({TRAINING})")
def j2(spark, sf):
    return training(spark, sf).withColumn("ipa", F.sha2("ipa", 256))


@query("j3_kept_clips", "select doc_id, lang, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def j3(spark, sf):
    return manifest.kept(b.table(spark, sf, "documents"), b.table(spark, sf, "labels").filter("quality = 1"), "doc_id").select("doc_id", "lang", "source")


@query("j4_ordinal_zip", """
  with r as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as ordinal from orders),
  e as (select *, row_number() over (partition by k order by n nulls first, e_id) as ordinal from (select o_custkey as k, l_orderkey * 10 + l_linenumber as e_id, case when l_linenumber > 1 then l_orderkey * 10 + l_linenumber end as n from lineitem join orders on o_orderkey = l_orderkey))
  select r.o_custkey, r.ordinal::int as ordinal, o_orderkey, n from r join e on e.k = r.o_custkey and e.ordinal = r.ordinal""")
def j4(spark, sf):
    orders = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    lines = b.table(spark, sf, "lineitem").join(orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    lines = lines.select("o_custkey", F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    return manifest.zip_ordinal(orders, lines, "o_custkey", "at", "n").select("o_custkey", "ordinal", "o_orderkey", "n")


LISTED = "select case when doc_id % 3 = 0 then '/data/cv-' || lang || '/audios/' when doc_id % 3 = 1 then '/data/b-xx-' || lang || '/audios/' else '/data/cv-zz/audios/' end || 'audio_' || doc_id || '.mp3' as path from documents"


@query("j5_audio_by_locale", f"select locale, c.audio_file, audio_id, min(path) as path from ({CORPUS}) c join ({LISTED}) l on l.path like '%/' || c.audio_file and l.path like '%-' || locale || '/audios/%' and regexp_extract(l.path, '[^/]+$') = c.audio_file group by 1, 2, 3")
def j5(spark, sf):
    d = b.table(spark, sf, "documents")
    top = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/data/cv-"), "lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/data/b-xx-"), "lang")).otherwise("/data/cv-zz")
    listed = d.select(F.concat(top, F.lit("/audios/audio_"), "doc_id", F.lit(".mp3")).alias("path"))
    return manifest.resolve_audio(corpus(spark, sf).select("locale", "audio_file", "audio_id"), listed)


@query("j8_combined", f"select speaker_name, count(*) as clips from (select upper(locale) as speaker_name from ({CORPUS}) where {USABLE} union all select role from conversations) group by 1")
def j8(spark, sf):
    first = manifest.corpus_manifest(corpus(spark, sf))
    return manifest.combine(first, turns(spark, sf)).groupBy("speaker_name").agg(F.count(F.lit(1)).alias("clips"))


BOTH = f"select text, speaker_name from ({TURNS}) union all select {b.sql_normalized('ipa_audio_universal')}, upper(locale) from ({CORPUS}) where {USABLE} and ipa_audio_universal <> ''"


def both(spark, sf):
    return manifest.combined_corpus(manifest.corpus_manifest(corpus(spark, sf)), turns(spark, sf))


@query("j8_speakers", f"select speaker, row_number() over (order by speaker) - 1 as speaker_id from (select distinct upper(speaker_name) as speaker from ({BOTH}))")
def j8s(spark, sf):
    return both(spark, sf)[2]


@query("j8_vocabulary", t.sql_vocabulary(f"select token, count(*) as count from (select unnest({b.sql_tokens('text')}) as token from ({BOTH})) group by token", f"select distinct upper(speaker_name) as code from ({BOTH})"))
def j8v(spark, sf):
    return both(spark, sf)[1]


# -- X

SPLIT = "select *, case when row_number() over (partition by {g} order by {k}) > count(*) over (partition by {g}) - greatest(1, floor(count(*) over (partition by {g}) * 0.1)) then 'val' else 'train' end as split from ({t})"


@query("x1_stratified_split", f"select segment_key, language_code, split from ({SPLIT.format(g='language_code', k='segment_key', t=TRAINING)})")
def x1(spark, sf):
    return splits.stratified(training(spark, sf)).select("segment_key", "language_code", "split")


@query("x2_split_by_column", f"select audio_id, case split when 'train' then 'train' when 'dev' then 'val' end as split from ({CORPUS})")
def x2(spark, sf):
    return corpus(spark, sf).select("audio_id", splits.by_column(F.col("split")).alias("split"))


@query("x3_manifest", f"""
  with g as ({SPLIT.format(g='language_code', k='segment_key', t=f"select segment_key, language_code, {b.sql_normalized('ipa')} as text from ({TRAINING}) where segment_file in (select 'segments/' || doc_id || '.wav' from labels where quality = 1)")})
  select 'wavs/' || segment_key || '.wav' as audio_file, sha256(text) as text, language_code as speaker_name, split from g where text <> ''""")
def x3(spark, sf):
    good = b.table(spark, sf, "labels").filter("quality = 1").select(F.format_string("segments/%d.wav", "doc_id").alias("segment_file"))
    rows = training(spark, sf)
    clips = rows.join(good.distinct(), "segment_file", "left_semi")
    return manifest.generate(rows, clips).withColumn("text", F.sha2("text", 256))


@query("x3_corpus_manifest", f"select split, upper(locale) as speaker_name, count(*) as clips from (select locale, case split when 'train' then 'train' when 'dev' then 'val' end as split, ipa_audio_universal as i from ({CORPUS})) where split is not null and i <> '' group by 1, 2")
def x3c(spark, sf):
    return manifest.corpus_manifest(corpus(spark, sf)).groupBy("split", "speaker_name").agg(F.count(F.lit(1)).alias("clips"))


@query("x3_written_counts", f"select count(*) as loaded, count(split)::bigint as in_split, count_if(split = 'train' and i <> '')::bigint as train, count_if(split = 'val' and i <> '')::bigint as val from (select case split when 'train' then 'train' when 'dev' then 'val' end as split, ipa_audio_universal as i from ({CORPUS}))")
def x3w(spark, sf):
    return manifest.write_corpus_manifest(corpus(spark, sf), sinks.scratch(spark))


# -- S9 and C: customers as a catalog

@query("s9_recordings", f"select recording_id, language_code, audio_filename from ({b.RECORDINGS}) where recording_type = 'word-list' and not downloaded and language_code = 'EN'")
def s9(spark, sf):
    return catalog.read_recordings(b.recordings(spark, sf), "en", "word-list", False).select("recording_id", "language_code", "audio_filename")


@query("s9_entries", f"select entry_id, recording_id, entry_number from ({b.ENTRIES}) where language_code = 'FR'")
def s9e(spark, sf):
    return catalog.read_entries(b.entries(spark, sf), language="fr").select("entry_id", "recording_id", "entry_number")


@query("s9_languages", b.LANGUAGES)
def s9l(spark, sf):
    return catalog.read_languages(b.languages(spark, sf))


#: Two halves of the customers' keys as a table and its update, which overlap.
OLD = "select c_custkey, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 3 <> 0"
NEW = "select c_custkey, case when c_custkey % 5 = 0 then null else 'new ' || c_name end as c_name, c_acctbal + 1 as c_acctbal from customer where c_custkey % 2 = 0"


def halves(spark, sf):
    c = b.table(spark, sf, "customer")
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("new "), "c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return c.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), new


@query("c1_upsert", f"select coalesce(n.c_custkey, o.c_custkey) as c_custkey, case when n.c_custkey is not null then n.c_name else o.c_name end as c_name, case when n.c_custkey is not null then n.c_acctbal else o.c_acctbal end as c_acctbal, o.c_mktsegment from ({OLD}) o full join ({NEW}) n on o.c_custkey = n.c_custkey")
def c1(spark, sf):
    return catalog.upsert(*halves(spark, sf), ["c_custkey"])


@query("c2_upsert_recordings", f"""
  with r as ({b.RECORDINGS}), o as (select recording_id, language_code, audio_filename, year, downloaded from r where recording_id % 3 <> 0), n as (select language_code, audio_filename, year + 1 as year from r where recording_id % 2 = 0),
  b as (select o.recording_id, coalesce(n.language_code, o.language_code) as language_code, coalesce(n.audio_filename, o.audio_filename) as audio_filename, case when n.year is not null then n.year else o.year end as year, o.downloaded from o full join n using (language_code, audio_filename))
  select coalesce(recording_id, (select max(recording_id) from o) + row_number() over (partition by recording_id is null order by language_code, audio_filename)) as recording_id, language_code, audio_filename, year, downloaded from b""")
def c2(spark, sf):
    r = b.recordings(spark, sf)
    old = r.filter("recording_id % 3 <> 0").select("recording_id", "language_code", "audio_filename", "year", "downloaded")
    return catalog.upsert_recordings(old, r.filter("recording_id % 2 = 0").select("language_code", "audio_filename", (F.col("year") + 1).alias("year")))


NEWER = "select entry_id + 1000000 as entry_id, recording_id from ({e}) where recording_id % 4 = 0"


@query("c3_replace_entries", f"select entry_id, recording_id from ({b.ENTRIES}) where recording_id % 4 <> 0 union all {NEWER.format(e=b.ENTRIES)}")
def c3(spark, sf):
    e = b.entries(spark, sf).select("entry_id", "recording_id")
    return catalog.replace_of(e, e.filter("recording_id % 4 = 0").select(F.col("entry_id") + 1000000, "recording_id").toDF("entry_id", "recording_id"))


@query("c4_replace_segments", f"select entry_id, recording_id from ({SEGMENTS}) where recording_id % 4 <> 0 union all {NEWER.format(e=SEGMENTS)}")
def c4(spark, sf):
    s = segments(spark, sf).select("entry_id", "recording_id")
    return catalog.replace_of(s, s.filter("recording_id % 4 = 0").select(F.col("entry_id") + 1000000, "recording_id").toDF("entry_id", "recording_id"))


@query("c5_mark_downloaded", f"select recording_id, audio_filename, downloaded or (n_entries % 5 > 0 and n_entries + case when recording_id % 2 = 0 then 1 else -1 end >= n_entries % 1000) as downloaded from (select *, n_entries % 1000 from ({b.RECORDINGS}))")
def c5(spark, sf):
    r = b.recordings(spark, sf)
    remote = r.select("audio_filename", F.when(F.col("n_entries") % 5 == 0, 0).otherwise(F.col("n_entries") % 1000).alias("size"))
    local = r.select("audio_filename", (F.col("n_entries") + F.when(F.col("recording_id") % 2 == 0, 1).otherwise(-1)).alias("size"))
    return catalog.mark_downloaded(r, remote, local).select("recording_id", "audio_filename", "downloaded")


@query("c6_audit", """
  select 'unique' as kind, 'orders' as table, 'o_orderkey' as columns, (select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1)) as violations
  union all select 'unique', 'orders', 'o_custkey', (select count(*) from (select 1 from orders group by o_custkey having count(*) > 1))
  union all select 'reference', 'lineitem', 'l_orderkey', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))
  union all select 'reference', 'events', 'user_id', (select count(*) from events where user_id not in (select c_custkey from customer where c_custkey % 2 = 0))
  union all select 'required', 'documents', 'text', (select count(*) from documents where text is null)""")
def c6(spark, sf):
    tables = {n: b.table(spark, sf, n) for n in ("orders", "lineitem", "events", "documents")} | {"customer": b.table(spark, sf, "customer").filter("c_custkey % 2 = 0")}
    return catalog.audit(tables, [("orders", ["o_orderkey"]), ("orders", ["o_custkey"])], [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("events", "user_id", "customer", "c_custkey")], [("documents", "text")])


@query("c7_row_counts", f"select 'languages' as table, count(*) as n from ({b.LANGUAGES}) union all select 'recordings', count(*) from ({b.RECORDINGS}) union all select 'entries', count(*) from documents")
def c7(spark, sf):
    return catalog.row_counts({"languages": b.languages(spark, sf), "recordings": b.recordings(spark, sf), "entries": b.entries(spark, sf)})


@query("c8_pending_downloads", f"select recording_id, wav_url from ({b.RECORDINGS}) where wav_url is not null and not downloaded")
def c8(spark, sf):
    return catalog.pending_downloads(b.recordings(spark, sf)).select("recording_id", "wav_url")


#: Clips of what is marked as toxic: some recordings have none.
SOME = f"select * from ({SEGMENTS}) where entry_id in (select doc_id from labels where toxic = 1)"


@query("c8_pending_segmentation", f"select recording_id, (select count(*) from ({SOME}) where recording_id in (select recording_id from ({b.RECORDINGS}) where recording_type = 'word-list' and downloaded)) as skipped from ({b.RECORDINGS}) where recording_type = 'word-list' and downloaded and recording_id not in (select recording_id from ({SOME}))")
def c8s(spark, sf):
    marked = b.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("entry_id"))
    some = segments(spark, sf).join(marked, "entry_id", "left_semi")
    r = b.recordings(spark, sf)
    return catalog.pending_segmentation(r, some).select("recording_id").crossJoin(F.broadcast(catalog.skipped_segments(r, some)))


@query("c9_missing_entries", f"""
  select recording_id, language_code, audio_filename, regexp_replace(wordlist_url, '#.*$', '') as page_url, regexp_replace(url, '/[^/]*$', '') || '/' || audio_filename || '.html' as expected_url,
    case when wordlist_url is null then 'no word list' when not contains(wordlist_url, 'word-list') then 'not a word list' else 'no rows parsed' end as reason
  from ({b.RECORDINGS}) r join ({b.LANGUAGES}) l on l.code = r.language_code where recording_id not in (select recording_id from ({b.ENTRIES}) where entry_id in (select doc_id from labels where toxic = 1))""")
def c9(spark, sf):
    """Of the entries those marked as toxic count as parsed, so that some recordings have none."""
    parsed = b.entries(spark, sf).join(b.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("entry_id")), "entry_id", "left_semi")
    return catalog.missing_entries(b.recordings(spark, sf), parsed, b.languages(spark, sf))


