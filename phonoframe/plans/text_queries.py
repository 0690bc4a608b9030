"""Queries on tokens: functions (N), vocabularies (V) and coverage reports (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ipa
from ..operators import stats, trainlog, vocab
from ..sources import sinks
from . import bindings as b

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# -- shared frames


def by_language(spark: SparkSession, sf: str) -> DataFrame:
    return stats.language_tokens(b.texts(spark, sf))


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.token_totals(by_language(spark, sf))


SQL_COARSE = f"""case when length(token) = 1 and token in ({_listed(ipa.STRESS)}) then 'stress' when length(token) = 1 and token in ({_listed(ipa.LENGTH)}) then 'length' when token = '.' then 'boundary'
  when length(token) = 1 and token in ({_listed(ipa.COARSE_VOWELS)}) then 'vowel' when length(token) = 1 then 'consonant' when left(token, 1) in ({_listed(ipa.COARSE_VOWELS)}) then 'vowel' else 'consonant' end"""
_FINE = [
    (ipa.STRESS, "suprasegmental", "stress"), (ipa.LENGTH, "suprasegmental", "length"), (ipa.VOWELS, "vowel", "oral"), (ipa.CLICKS, "consonant", "click"), (ipa.IMPLOSIVES, "consonant", "implosive"),
    (ipa.PLOSIVES, "consonant", "plosive"), (ipa.NASALS, "consonant", "nasal"), (ipa.TRILLS, "consonant", "trill"), (ipa.TAPS, "consonant", "tap/flap"), (ipa.FRICATIVES, "consonant", "fricative"),
    (ipa.LATERALS, "consonant", "lateral"), (ipa.APPROXIMANTS, "consonant", "approximant"), (ipa.BOUNDARIES, "boundary", "syllable/word"),
]


def _fine(part: int) -> str:
    tilde = ("'vowel'", "'nasalized'")[part]
    nasal = f"when left(token, 1) in ({_listed(ipa.VOWELS)}) and contains(token, '̃') then {tilde}"
    whens = " ".join(f"when left(token, 1) in ({_listed(sounds)}) then '{(cat, sub)[part]}'" for sounds, cat, sub in _FINE)
    return f"case {nasal} {whens} when regexp_matches(left(token, 1), '\\p{{L}}') then '{('consonant', 'other')[part]}' else '{('other', 'unknown')[part]}' end"


CLASSIFIED = f"select token, count, {_fine(0)} as cat, {_fine(1)} as subcat from ({b.TOTALS})"
SQL_POINTS = "list_aggregate([{p} || case when ord(c) < 65536 then lpad(printf('%X', ord(c)), 4, '0') else printf('%X', ord(c)) end for c in regexp_extract_all(token, '(?s).')], 'string_agg', '{s}')"
RATING = "case when count >= 10000 then 'Excellent' when count >= 1000 then 'Good' when count >= 100 then 'Limited' when count >= 10 then 'Poor' else 'Minimal' end"

# -- N


@query("n1_normalize_ipa", f"select doc_id, sha256({b.sql_normalized('text')}) as normalized_sha256 from documents")
def n1(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.sha2(ipa.normalize_ipa(F.col("text")), 256).alias("normalized_sha256"))


@query("n2_tokenize", f"select doc_id, len(t)::int as n_tokens, sha256(array_to_string(t, ' ')) as tokens_sha256 from (select doc_id, {b.sql_tokens('text')} as t from documents)")
def n2(spark, sf):
    t = b.table(spark, sf, "documents").select("doc_id", ipa.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query("n3_join_phones", "select doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) as joined_sha256 from documents")
def n3(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.sha2(ipa.join_phones(F.col("text")), 256).alias("joined_sha256"))


@query("n4_keys", "select o_orderkey, lower(o_orderstatus) || '_' || case when o_orderkey < 1000 then lpad(o_orderkey::varchar, 3, '0') else o_orderkey::varchar end as entry_id, o_orderpriority || '_' || case when o_custkey < 1000 then lpad(o_custkey::varchar, 3, '0') else o_custkey::varchar end as segment_key from orders")
def n4(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", ipa.entry_id(F.col("o_orderstatus"), F.col("o_orderkey")).alias("entry_id"), ipa.segment_key(F.col("o_orderpriority"), F.col("o_custkey")).alias("segment_key"))


@query("n5_file_stem", "select page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) as stem from pages")
def n5(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", ipa.file_stem(F.col("url")).alias("stem"))


@query("n6_base_character", f"select left(token, 1) as base, count(*) as tokens, sum(count)::bigint as count from ({b.TOTALS}) group by 1")
def n6(spark, sf):
    return totals(spark, sf).groupBy(ipa.base_character(F.col("token")).alias("base")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("count").alias("count"))


@query("n7_coarse_category", f"select token, {SQL_COARSE} as category from ({b.TOTALS})")
def n7(spark, sf):
    return totals(spark, sf).select("token", ipa.coarse_category(F.col("token")).alias("category"))


@query("n8_fine_category", f"select token, cat, subcat from ({CLASSIFIED})")
def n8(spark, sf):
    return stats.classified(totals(spark, sf)).select("token", "cat", "subcat")


@query("n9_code_points", f"select token, {SQL_POINTS.format(p=chr(39) + 'U+' + chr(39), s=' ')} as code_points from ({b.TOTALS})")
def n9(spark, sf):
    return totals(spark, sf).select("token", ipa.code_points(F.col("token")).alias("code_points"))


SQL_NOTES = "case when n = '' then '—' else n end"
NOTED = f"select *, concat_ws(', ', case when count < 10 then 'rare' end, case when count < 100 then 'limited data' end, case when regexp_matches(token, '[^\\x00-\\x7F]') then 'U+' || {SQL_POINTS.format(p=chr(39) * 2, s='+')} end) as n from"


@query("n10_rarity_notes", f"select token, count, {SQL_NOTES} as notes from ({NOTED} ({b.TOTALS}))")
def n10(spark, sf):
    return totals(spark, sf).select("token", "count", ipa.rarity_notes(F.col("token"), F.col("count")).alias("notes"))


@query("n11_coverage_rating", f"select token, count, {RATING} as rating from ({b.TOTALS})")
def n11(spark, sf):
    return totals(spark, sf).select("token", "count", ipa.coverage_rating(F.col("count")).alias("rating"))


@query("n12_recommendation", f"select token, count, case when count < 100 then 'Unlikely to work correctly' when count < 500 then 'May produce inconsistent results' else 'Usable with caution' end as recommendation from ({b.TOTALS})")
def n12(spark, sf):
    return totals(spark, sf).select("token", "count", ipa.recommendation(F.col("count")).alias("recommendation"))


@query("n13_latest_artefact", "select user_id, max(event_id) as step, 'run' || user_id || '/checkpoint_' || max(event_id) || '.pth' as path from events group by user_id")
def n13(spark, sf):
    """Events as saved artefacts of a user's run: the one of the largest step."""
    return trainlog.latest_artefact(artefacts(spark, sf)).withColumnRenamed("run", "user_id")


def artefacts(spark, sf):
    return b.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.format_string("run%d/checkpoint_%d.pth", "user_id", "event_id").alias("path"))


@query("n13_latest_run", "select 'run' || user_id as run from events order by 1 desc limit 1")
def n13r(spark, sf):
    return trainlog.latest_run(artefacts(spark, sf).withColumn("run", F.regexp_extract("path", "^([^/]+)/", 1)))


# -- V

CODES = "select distinct upper(lang) as code from documents"


def sql_vocabulary(totals: str, codes: str) -> str:
    return f"""
  select i as id, t as token, 'special' as kind from (select unnest(range({len(vocab.SPECIALS)})) as i, unnest([{_listed(vocab.SPECIALS)}]) as t)
  union all select row_number() over (order by count desc, token) + 5, token, 'phoneme' from ({totals}) where count >= 2
  union all select row_number() over (order by code) + 5 + (select count(*) from ({totals}) where count >= 2), code, 'language' from ({codes})"""


VOCABULARY = sql_vocabulary(b.TOTALS, CODES)


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return b.texts(spark, sf).select(F.col("language_code").alias("code")).distinct()


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.build_vocabulary(totals(spark, sf), codes(spark, sf))


@query("v1_token_frequency", b.TOTALS)
def v1(spark, sf):
    return stats.token_counts(b.texts(spark, sf))


@query("v2_vocabulary", VOCABULARY)
def v2(spark, sf):
    return vocabulary(spark, sf)


@query("v3_vocabulary_statistics", f"select sum(count)::bigint as total, count(*) as unique_tokens, count(*) filter (count >= 2) as kept, count(*) filter (count < 2) as dropped, (select count(*) from ({CODES})) as languages, count(*) filter (count >= 2) + (select count(*) from ({CODES})) + 6 as size from ({b.TOTALS})")
def v3(spark, sf):
    return vocab.vocabulary_statistics(totals(spark, sf), codes(spark, sf))


@query("v3_top_tokens", f"select token, count, 100.0 * count / (select sum(count) from ({b.TOTALS})) as pct from ({b.TOTALS}) order by count desc, token limit 20")
def v3_top(spark, sf):
    return stats.top_tokens(sinks.stored(totals(spark, sf)), 20).select("token", "count", "pct")


#: A vocabulary of documents applied to the benchmark's texts: some of their tokens are unknown to it.
SQL_ENCODED = f"""
  select item_id, list(coalesce(v.id, 3) order by pos) as ids from (select item_id, unnest(t) as token, unnest(range(len(t))) as pos from (select item_id, {b.sql_tokens('text')} as t from benchmark)) x
  left join (select token, max(id) as id from ({VOCABULARY}) where id % 4 <> 1 or id < 6 group by token) v on v.token = x.token group by item_id"""


def _items(spark, sf):
    return b.table(spark, sf, "benchmark").select("item_id", ipa.tokenize(F.col("text")).alias("tokens"))


def _thinned(vocabulary):
    return vocabulary.filter("id % 4 <> 1 or id < 6")


@query("v4_encode", f"select item_id, array_to_string(ids, ' ') as ids from ({SQL_ENCODED})")
def v4(spark, sf):
    return vocab.encode(_items(spark, sf), _thinned(vocabulary(spark, sf)), "item_id").select("item_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("v5_decode", f"select item_id, string_agg(coalesce(v.token, '<unk>'), ' ' order by pos) as tokens from (select item_id, unnest(ids) as id, unnest(range(len(ids))) as pos from ({SQL_ENCODED})) x left join ({VOCABULARY}) v on v.id = x.id group by item_id")
def v5(spark, sf):
    v = sinks.stored(vocabulary(spark, sf))
    coded = vocab.encode(_items(spark, sf), _thinned(v), "item_id")
    return vocab.decode(coded, v, "item_id").select("item_id", F.array_join("tokens", " ").alias("tokens"))


@query("v6_speaker_map", f"select code as speaker, row_number() over (order by code) - 1 as speaker_id from ({CODES})")
def v6(spark, sf):
    return vocab.speaker_map(codes(spark, sf), "code")


@query("v7_character_set", f"select string_agg(c, '' order by ord(c)) as characters, count(*) as size from (select distinct unnest(regexp_extract_all(token, '(?s).')) as c from ({VOCABULARY}) where kind = 'phoneme')")
def v7(spark, sf):
    return vocab.character_set(vocabulary(spark, sf))


# -- G

ALL = f"(select sum(count) from ({b.TOTALS}))"


@query("g1_overview", f"select (select count(*) from documents) as entries, sum(count)::bigint as tokens, count(*) as unique_tokens, (select count(distinct lang) from documents) as languages, sum(count) / (select count(*) from documents) as tokens_per_entry from ({b.TOTALS})")
def g1(spark, sf):
    return stats.overview(b.texts(spark, sf), by_language(spark, sf))


@query("g2_coarse_breakdown", f"select {SQL_COARSE} as category, sum(count)::bigint as count, 100.0 * sum(count) / {ALL} as pct from ({b.TOTALS}) group by 1")
def g2(spark, sf):
    return stats.coarse_breakdown(totals(spark, sf))


@query("g3_top_tokens", f"select token, count, 100.0 * count / {ALL} as pct, {SQL_COARSE} as category, {SQL_POINTS.format(p=chr(39) + 'U+' + chr(39), s=' ')} as code_points from ({b.TOTALS}) order by count desc, token limit 50")
def g3(spark, sf):
    return stats.top_tokens(sinks.stored(totals(spark, sf)))


@query("g4_rare_tokens", f"select token, count, {SQL_POINTS.format(p=chr(39) + 'U+' + chr(39), s=' ')} as code_points, (select count(*) from ({b.TOTALS}) where count <= 1000) as rare_total from ({b.TOTALS}) where count <= 1000 order by count, token limit 50")
def g4(spark, sf):
    """These texts have few tokens, so that rare means up to 1,000 here."""
    return stats.rare_tokens(sinks.stored(totals(spark, sf)), 1000)


@query("g5_hapax", f"select count(*) filter (count = 1) as hapax, count(*) filter (count <= 10) as up_to_10 from ({b.TOTALS})")
def g5(spark, sf):
    return stats.hapax(totals(spark, sf))


LENGTHS = f"select len({b.sql_tokens('text')}) as length, count(*) as count from documents group by 1"


@query("g6_length_histogram", f"""
  with l as ({LENGTHS}), a as (select sum(count) as a from l)
  select bucket, count, 100.0 * count / a as pct from (
    (select length::varchar as bucket, count from l order by length limit 20)
    union all select '21+', sum(count)::bigint from l where length > 20 having count(*) > 0), a""")
def g6(spark, sf):
    return stats.length_histogram(b.texts(spark, sf))


@query("g7_languages_by_unique", f"select language_code, count(*) as unique_tokens, sum(count)::bigint as tokens from ({b.BY_LANGUAGE}) group by 1 order by 2 desc, 1 limit 20")
def g7(spark, sf):
    return stats.languages_by_unique(by_language(spark, sf))


@query("g7_merged_sketches", f"select language_code, entries, tokens, unique_tokens from (select upper(lang) as language_code, count(*) as entries from documents group by 1) join (select language_code, sum(count)::bigint as tokens, count(*) as unique_tokens from ({b.BY_LANGUAGE}) group by 1) using (language_code)")
def g7m(spark, sf):
    """Each source as a batch of its own; so few tokens are counted exactly by a sketch."""
    e = b.table(spark, sf, "documents").select("source", F.upper("lang").alias("language_code"), F.col("text").alias("ipa"))
    return stats.merged_sketches(stats.language_sketches(e, "source"), "language_code").drop("sketch")


@query("g1_merged_sketches", f"select (select count(*) from documents) as entries, sum(count)::bigint as tokens, count(*) as unique_tokens from ({b.TOTALS})")
def g1m(spark, sf):
    return stats.merged_sketches(stats.language_sketches(b.texts(spark, sf))).drop("sketch")


PLACES = "select unnest(range({n})) as place, unnest([{c}]) as cat, unnest([{s}]) as subcat".format(n=len(ipa.CLASSES), c=_listed([c for c, _ in ipa.CLASSES]), s=_listed([s for _, s in ipa.CLASSES]))
SUMMARY = f"select place::int as place, cat, subcat, unique_tokens, count, 100.0 * count / {ALL} as pct, {RATING} as rating from (select cat, subcat, count(*) as unique_tokens, sum(count)::bigint as count from ({CLASSIFIED}) group by 1, 2) join ({PLACES}) using (cat, subcat)"


@query("g8_category_summary", SUMMARY)
def g8(spark, sf):
    return stats.category_summary(totals(spark, sf))


RANKED = f"select *, row_number() over (partition by cat, subcat order by count desc, token) as place from ({CLASSIFIED})"


@query("g9_category_inventory", f"""
  select cat, subcat, place::int as place, token, count, 100.0 * count / {ALL} as pct, {SQL_NOTES} as notes from ({NOTED} ({RANKED})) where place <= 10
  union all select cat, subcat, 11, '...', null, null, '+' || count(*) || ' more tokens' from ({RANKED}) where place > 10 group by 1, 2""")
def g9(spark, sf):
    return stats.category_inventory(sinks.stored(totals(spark, sf)), 10)


@query("g10_under_represented", f"select cat, subcat, count(*) as unique_tokens, sum(count)::bigint as count, case when sum(count) < 100 then 'Unlikely to work correctly' when sum(count) < 500 then 'May produce inconsistent results' else 'Usable with caution' end as recommendation from ({CLASSIFIED}) group by 1, 2 having sum(count) < 1000000 and cat not in ('boundary', 'other', 'modifier')")
def g10(spark, sf):
    return stats.under_represented(totals(spark, sf), 1_000_000)


@query("g11_language_statistics", f"select * from (select upper(lang) as language_code, 'Language ' || upper(lang) as name, count(*) as entries from documents group by 1, 2) join (select language_code, sum(count)::bigint as tokens, count(*) as unique_tokens from ({b.BY_LANGUAGE}) group by 1) using (language_code) order by tokens desc, language_code limit 30")
def g11(spark, sf):
    return stats.language_statistics(b.texts(spark, sf), by_language(spark, sf)).orderBy(F.desc("tokens"), "language_code").limit(30)


@query("g12_low_resource", "select upper(lang) || '-' || source as language_code, count(*) as entries from documents group by 1 having count(*) < 50")
def g12(spark, sf):
    """By language and source, as every language here has many entries."""
    e = b.table(spark, sf, "documents").select(F.concat(F.upper("lang"), F.lit("-"), "source").alias("language_code"))
    return stats.low_resource(e)


@query("g13_report", f"""
  select (select count(*) from documents) as entries, sum(count)::bigint as tokens, (select count(*) from ({SUMMARY})) as classes, (select sum(unique_tokens * (place + 1))::bigint from ({SUMMARY})) as summary_check, count(*) as token_counts,
    (select count(distinct lang) from documents) as languages, first(token order by count desc, token) as first_token, (select count(*) from (select 1 from ({CLASSIFIED}) group by cat, subcat having sum(count) < 1000 and cat not in ('boundary', 'other', 'modifier'))) as under_represented,
    (select sum(place)::bigint from ({RANKED}) where place <= 30) + (select 31 * count(*) from (select distinct cat, subcat from ({RANKED}) where place > 30)) as inventory_check,
    (select count(*) from (select lang from documents group by lang having count(*) < 50)) as low_resource, (select string_agg(language_code || ':' || tokens || ':' || unique_tokens, ',' order by language_code) from (select language_code, sum(count)::bigint as tokens, count(*) as unique_tokens from ({b.BY_LANGUAGE}) group by 1)) as language_stats
  from ({b.TOTALS})""")
def g13(spark, sf):
    """The report's JSON, read again: what each section holds, by counts and sums."""
    report = stats.report_json(b.texts(spark, sf), by_language(spark, sf))
    schema = """overview struct<entries:long,tokens:long>, category_summary array<struct<place:long,unique_tokens:long>>, category_inventory array<struct<place:long>>, under_represented array<struct<cat:string>>,
      token_counts array<struct<token:string>>, language_stats array<struct<language_code:string,tokens:long,unique_tokens:long>>, low_resource array<struct<language_code:string>>"""
    r = report.select(F.from_json("report", schema).alias("r")).select("r.*")
    total = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0).cast("long"), lambda a, v: a + v)
    n = lambda c: F.size(c).cast("long").alias(c)
    each = F.transform("language_stats", lambda x: F.concat_ws(":", x["language_code"], x["tokens"], x["unique_tokens"]))
    return r.select(
        "overview.entries", "overview.tokens", F.size("category_summary").cast("long").alias("classes"), total("category_summary", lambda x: x["unique_tokens"] * (x["place"] + 1)).alias("summary_check"), n("token_counts"),
        F.size("language_stats").cast("long").alias("languages"), F.element_at("token_counts", 1)["token"].alias("first_token"), n("under_represented"), total("category_inventory", lambda x: x["place"]).alias("inventory_check"),
        n("low_resource"), F.array_join(each, ",").alias("language_stats"),
    )


@query("g14_frame_statistics", "select count(*) as n, avg(f) as mean, median(f) as median, stddev_pop(f) as std, min(f) as least, max(f) as most, avg(f) * 1000 * 256 / 22050 as mean_ms from (select greatest(1, trunc(len(w) * 0.05 * 22050 / 256))::int as f from (select unnest(string_split(text, ' ')) as w from conversations))")
def g14(spark, sf):
    from ..operators import align

    words = b.table(spark, sf, "conversations").select(F.explode(F.split("text", " ")).alias("w"))
    return align.frame_statistics(words.select(align.frames(F.lit(0.0), F.length("w") * 0.05).alias("frames")))


TITLED = "case subcat when 'tap/flap' then 'Tap/Flap' when 'syllable/word' then 'Syllable/Word' else array_to_string([upper(w[1]) || w[2:] for w in string_split(subcat, ' ')], ' ') end"


@query("k8_report_lines", f"""
  select 0 as line_no, '| Category | Subcategory | Unique Sounds | Total Tokens | % of Data | Coverage |' as text union all select 1, '|----------|-------------|---------------|--------------|-----------|----------|'
  union all select place + 2, '| ' || upper(cat[1]) || cat[2:] || ' | ' || {TITLED} || ' | ' || format('{{:,}}', unique_tokens) || ' | ' || format('{{:,}}', count) || ' | ' || printf('%.1f', pct) || '% | ' || rating || ' |' from ({SUMMARY})""")
def k8(spark, sf):
    return stats.report_lines(totals(spark, sf))


NAMED = f"upper(cat[1]) || cat[2:] || ': ' || {TITLED}"


@query("k8_inventory_lines", f"""
  select place, line_no::int as line_no, text from (
    select place, unnest(range(6)) as line_no, unnest(['#### ' || {NAMED}, '', 'Total: ' || format('{{:,}}', count) || ' tokens, ' || unique_tokens || ' unique', '', '| Token | Count | % | Notes |', '|-------|-------|---|-------|']) as text from ({SUMMARY})
    union all select s.place, r.place + 5, case when r.place <= 10 then '| ' || token || ' | ' || format('{{:,}}', count) || ' | ' || printf('%.2f', 100.0 * count / {ALL}) || '% | ' || notes || ' |' else '| ... | | | +' || more || ' more tokens |' end
    from (select cat, subcat, place, token, count, {SQL_NOTES} as notes, null as more from ({NOTED} ({RANKED})) where place <= 10 union all select cat, subcat, 11, null, null, null, count(*) from ({RANKED}) where place > 10 group by 1, 2) r join ({PLACES}) s using (cat, subcat))""")
def k8i(spark, sf):
    return stats.inventory_lines(sinks.stored(totals(spark, sf)), 10).select(F.col("place").cast("int").alias("place"), "line_no", "text")


@query("k8_under_represented_lines", f"""
  select 0::bigint as line_no, '| Category | Total Tokens | Unique | Recommendation |' as text union all select 1, '|----------|--------------|--------|----------------|'
  union all select 1 + row_number() over (order by count, cat, subcat), '| ' || {NAMED} || ' | ' || format('{{:,}}', count) || ' | ' || unique_tokens || ' | ' || recommendation || ' |' from ({SQL['g10_under_represented']})""")
def k8u(spark, sf):
    return stats.under_represented_lines(totals(spark, sf), 1_000_000)


@query("k8_rare_lines", f"""
  select 0::bigint as line_no, '- **Hapax legomena** (appear once): ' || hapax || ' tokens' as text from ({SQL['g5_hapax']})
  union all select 1, '- **Very rare** (≤10 occurrences): ' || up_to_10 || ' tokens' from ({SQL['g5_hapax']})""")
def k8r(spark, sf):
    return stats.rare_lines(totals(spark, sf))


@query("k8_language_lines", f"""
  select 0::bigint as line_no, '| Language | Code | Entries | Tokens | Unique Tokens |' as text union all select 1, '|----------|------|---------|--------|---------------|'
  union all select 1 + row_number() over (order by tokens desc, language_code), '| ' || name || ' | ' || language_code || ' | ' || format('{{:,}}', entries) || ' | ' || format('{{:,}}', tokens) || ' | ' || unique_tokens || ' |' from ({SQL['g11_language_statistics']})
  union all select 32, '### Languages with Minimal Data (<50 entries): ' || (select count(*) from (select lang from documents group by lang having count(*) < 50))""")
def k8l(spark, sf):
    return stats.language_lines(b.texts(spark, sf), by_language(spark, sf))
