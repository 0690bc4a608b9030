"""Corpus coverage: categories, rare tokens, lengths, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ipa
from ..sources import sinks


def token_table(entries: DataFrame, *keep: str, text: str = "ipa") -> DataFrame:
    """(``keep`` columns, token): one row per token."""
    return entries.select(*keep, F.explode(ipa.tokenize(F.col(text))).alias("token"))


def token_counts(entries: DataFrame, *keep: str, text: str = "ipa") -> DataFrame:
    """(``keep`` columns, token, count): as ``token_table``, counted. No token goes beyond white space, so that words are counted first and each distinct one is split to tokens once, long ones in pieces."""
    words = entries.select(*keep, F.explode(F.split(F.col(text), ipa.WORD_END)).alias("_word")).filter("_word <> ''").groupBy(*keep, "_word").agg(F.count(F.lit(1)).alias("_n"))
    cut = words.select(*keep, "_n", F.explode(ipa.pieces(F.col("_word"))).alias("_piece"))
    return cut.select(*keep, "_n", F.explode(ipa.tokenize(F.col("_piece"))).alias("token")).groupBy(*keep, "token").agg(F.sum("_n").alias("count"))


def language_tokens(entries: DataFrame) -> DataFrame:
    """(language_code, token, count): the table that every report starts from; distinct tokens are few."""
    return token_counts(entries, "language_code")


def token_totals(by_language: DataFrame) -> DataFrame:
    return by_language.groupBy("token").agg(F.sum("count").alias("count"))


def overview(entries: DataFrame, by_language: DataFrame) -> DataFrame:
    """One row: entries, tokens, unique_tokens, languages, tokens_per_entry."""
    n = entries.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("language_code").alias("languages"))
    t = by_language.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.countDistinct("token").alias("unique_tokens"))
    return n.crossJoin(t).select("entries", "tokens", "unique_tokens", "languages", F.try_divide("tokens", "entries").alias("tokens_per_entry"))


def _share(df: DataFrame) -> DataFrame:
    """With pct of the whole count; the table is an aggregate."""
    total = df.agg(F.sum("count").alias("_all"))
    return df.crossJoin(F.broadcast(total)).withColumn("pct", 100.0 * F.col("count") / F.col("_all")).drop("_all")


def _share_of_few(df: DataFrame) -> DataFrame:
    """As _share for tables of a few classes: one window over them, so that what they come from is made once."""
    return df.withColumn("pct", 100.0 * F.col("count") / F.sum("count").over(W.Window.partitionBy()))


def coarse_breakdown(totals: DataFrame) -> DataFrame:
    return _share_of_few(totals.groupBy(ipa.coarse_category(F.col("token")).alias("category")).agg(F.sum("count").alias("count")))


def top_tokens(totals: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent tokens, ties by token."""
    best = _share(totals).orderBy(F.desc("count"), "token").limit(k)
    return best.select("token", "count", "pct", ipa.coarse_category(F.col("token")).alias("category"), ipa.code_points(F.col("token")).alias("code_points"))


def rare_tokens(totals: DataFrame, most: int = 10, listed: int = 50) -> DataFrame:
    """The first of the tokens with counts up to ``most``, ascending, each with how many there are in all."""
    rare = totals.filter(F.col("count") <= most)
    total = rare.agg(F.count(F.lit(1)).alias("rare_total"))
    return rare.orderBy("count", "token").limit(listed).crossJoin(F.broadcast(total)).select("token", "count", ipa.code_points(F.col("token")).alias("code_points"), "rare_total")


def hapax(totals: DataFrame) -> DataFrame:
    return totals.agg(F.count_if(F.col("count") == 1).alias("hapax"), F.count_if(F.col("count") <= 10).alias("up_to_10"))


def token_lengths(entries: DataFrame, text: str = "ipa") -> DataFrame:
    """(length): as ``ipa.token_count``, by steps, so that what several expressions take is made once."""
    whole = entries.select(ipa.unbracketed(F.col(text)).alias("_t"))
    return whole.select("_t", ipa.edges(F.col("_t")).alias("_e")).select(ipa.tokens_of_edges(F.col("_t"), F.col("_e")).alias("length"))


def length_histogram(entries: DataFrame, shown: int = 20) -> DataFrame:
    """(bucket, count, pct): the least observed lengths, and one bucket for all over ``shown``, if there are any. The lengths are stored, as three parts read them."""
    lengths = sinks.stored(token_lengths(entries).groupBy("length").agg(F.count(F.lit(1)).alias("count")))
    total = F.broadcast(lengths.agg(F.sum("count").alias("_all")))
    least = lengths.orderBy("length").limit(shown).select(F.col("length").cast("string").alias("bucket"), "count")
    longer = lengths.filter(F.col("length") > shown).agg(F.sum("count").alias("count")).filter("count is not null").select(F.lit(f"{shown + 1}+").alias("bucket"), "count")
    return least.unionByName(longer).crossJoin(total).select("bucket", "count", (100.0 * F.col("count") / F.col("_all")).alias("pct"))


def languages_by_unique(by_language: DataFrame, k: int = 20) -> DataFrame:
    each = by_language.groupBy("language_code").agg(F.count(F.lit(1)).alias("unique_tokens"), F.sum("count").alias("tokens"))
    return each.orderBy(F.desc("unique_tokens"), "language_code").limit(k)


def language_sketches(entries: DataFrame, *keep: str, lg_registers: int = 12) -> DataFrame:
    """(``keep`` columns, language_code, entries, tokens, sketch): of each language's tokens how many there are, and a sketch of which.

    A batch of a growing corpus is added by a union with what is kept of the ones before, see ``merged_sketches``; texts aren't read again. A sketch has a few
    kilobytes, whatever its tokens are.
    """
    per = entries.groupBy(*keep, "language_code").agg(F.count(F.lit(1)).alias("entries"))
    each = token_counts(entries, *keep, "language_code").groupBy(*keep, "language_code").agg(F.sum("count").alias("tokens"), F.hll_sketch_agg("token", lg_registers).alias("sketch"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keep, "language_code"]]
    return per.alias("a").join(each.alias("b"), same, "left").select("a.*", F.coalesce("b.tokens", F.lit(0).cast("long")).alias("tokens"), "b.sketch")


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, entries, tokens, unique_tokens, sketch): batches, languages or both put together; unique_tokens is within about 2 % of the exact number."""
    both = sketches.groupBy(*keys).agg(F.sum("entries").alias("entries"), F.sum("tokens").alias("tokens"), F.hll_union_agg("sketch").alias("sketch"))
    return both.select(*keys, "entries", "tokens", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0).cast("long")).alias("unique_tokens"), "sketch")


def classified(totals: DataFrame) -> DataFrame:
    """Every distinct token with its fine class."""
    return totals.withColumn("_c", ipa.fine_category(F.col("token"))).select("token", "count", "_c.cat", "_c.subcat")


def category_summary(totals: DataFrame) -> DataFrame:
    """(place, cat, subcat, unique_tokens, count, pct, rating) of the classes there are."""
    order = totals.sparkSession.createDataFrame([(i, c, s) for i, (c, s) in enumerate(ipa.CLASSES)], "place int, cat string, subcat string")
    each = classified(totals).groupBy("cat", "subcat").agg(F.count(F.lit(1)).alias("unique_tokens"), F.sum("count").alias("count"))
    return _share_of_few(each).join(F.broadcast(order), ["cat", "subcat"]).select("place", "cat", "subcat", "unique_tokens", "count", "pct", ipa.coverage_rating(F.col("count")).alias("rating"))


def category_inventory(totals: DataFrame, k: int = 30) -> DataFrame:
    """The top k tokens of each class with share and notes, and one row '...' for the rest of it."""
    ranked = _share(classified(totals)).withColumn("place", F.row_number().over(W.Window.partitionBy("cat", "subcat").orderBy(F.desc("count"), "token")))
    shown = ranked.filter(F.col("place") <= k).select("cat", "subcat", "place", "token", "count", "pct", ipa.rarity_notes(F.col("token"), F.col("count")).alias("notes"))
    more = ranked.filter(F.col("place") > k).groupBy("cat", "subcat").agg(F.count(F.lit(1)).alias("n"))
    rest = more.select("cat", "subcat", F.lit(k + 1).alias("place"), F.lit("...").alias("token"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("pct"), F.format_string("+%d more tokens", "n").alias("notes"))
    return shown.unionByName(rest)


def under_represented(totals: DataFrame, least: int = 1000) -> DataFrame:
    """The classes with less than ``least`` tokens. Which classes are told of is looked at in their sums: Spark would push a filter by class down to each token of each word."""
    told = F.bool_or(~F.col("cat").isin("boundary", "other", "modifier"))
    each = classified(totals).groupBy("cat", "subcat").agg(F.count(F.lit(1)).alias("unique_tokens"), F.sum("count").alias("count"), told.alias("_told"))
    return each.filter((F.col("count") < least) & F.col("_told")).drop("_told").withColumn("recommendation", ipa.recommendation(F.col("count")))


def language_statistics(entries: DataFrame, by_language: DataFrame) -> DataFrame:
    """(language_code, name, entries, tokens, unique_tokens); the name is that of the last entry."""
    n = entries.groupBy("language_code").agg(F.max_by("language_name", "entry_id").alias("name"), F.count(F.lit(1)).alias("entries"))
    t = by_language.groupBy("language_code").agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("unique_tokens"))
    return n.join(t, "language_code", "left").fillna(0, ["tokens", "unique_tokens"])


def low_resource(entries: DataFrame, least: int = 50) -> DataFrame:
    return entries.groupBy("language_code").agg(F.count(F.lit(1)).alias("entries")).filter(F.col("entries") < least)


def report_json(entries: DataFrame, by_language: DataFrame) -> DataFrame:
    """One row with the whole report as JSON, from aggregates alone; the table of tokens is stored and read by all of them."""
    by_language = sinks.stored(by_language)
    totals = token_totals(by_language)
    rows = lambda df, *order: df.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("x"))
    parts = {
        "overview": overview(entries, by_language).select(F.struct("*").alias("x")),
        "category_summary": rows(category_summary(totals), "place", "cat", "subcat", "unique_tokens", "count", "rating"),
        "category_inventory": rows(category_inventory(totals), "cat", "subcat", "place", "token", "count", "notes"),
        "under_represented": rows(under_represented(totals), "cat", "subcat", "unique_tokens", "count", "recommendation"),
        "token_counts": rows(totals.withColumn("less", -F.col("count")), "less", "token", "count"),
        "language_stats": rows(language_statistics(entries, by_language), "language_code", "name", "entries", "tokens", "unique_tokens"),
        "low_resource": rows(low_resource(entries), "language_code", "entries"),
    }
    out = None
    for name, df in parts.items():
        df = df.withColumnRenamed("x", name)
        out = df if out is None else out.crossJoin(df)
    return out.select(F.to_json(F.struct(*parts)).alias("report"))


def titled(words: Column) -> Column:
    """Each word with a capital, after a slash too."""
    return F.replace(F.initcap(F.replace(words, F.lit("/"), F.lit("/ "))), F.lit("/ "), F.lit("/"))


# Fixed values in what follows: the forms of the report's tables and headings.


def _headed(rows: DataFrame, *head: str) -> DataFrame:
    """(line_no, text) below the lines of a head."""
    top = rows.sparkSession.createDataFrame(list(enumerate(head)), "line_no long, text string")
    return top.unionByName(rows.select((F.col("line_no") + len(head)).cast("long").alias("line_no"), "text"))


def report_lines(totals: DataFrame) -> DataFrame:
    """The category table as ordered lines of Markdown: (line_no, text)."""
    s = category_summary(totals)
    line = F.format_string("| %s | %s | %,d | %,d | %.1f%% | %s |", titled(F.col("cat")), titled(F.col("subcat")), "unique_tokens", "count", "pct", "rating")
    return _headed(s.select(F.col("place").alias("line_no"), line.alias("text")), "| Category | Subcategory | Unique Sounds | Total Tokens | % of Data | Coverage |", "|----------|-------------|---------------|--------------|-----------|----------|").withColumn("line_no", F.col("line_no").cast("int"))


def inventory_lines(totals: DataFrame, k: int = 30) -> DataFrame:
    """The tokens of each class as lines of Markdown: (place of the class, line_no in it, text)."""
    name = F.concat(titled(F.col("cat")), F.lit(": "), titled(F.col("subcat")))
    sums = category_summary(totals).select("place", "cat", "subcat", "unique_tokens", "count")
    head = F.array(F.concat(F.lit("#### "), name), F.lit(""), F.format_string("Total: %,d tokens, %d unique", "count", "unique_tokens"), F.lit(""), F.lit("| Token | Count | % | Notes |"), F.lit("|-------|-------|---|-------|"))
    heads = sums.select("place", F.posexplode(head).alias("line_no", "text"))
    n = 6  # lines of the head
    rows = category_inventory(totals, k).withColumnRenamed("place", "rank").join(F.broadcast(sums.select("place", "cat", "subcat")), ["cat", "subcat"])
    line = F.when(F.col("count").isNull(), F.format_string("| ... | | | %s |", "notes")).otherwise(F.format_string("| %s | %,d | %.2f%% | %s |", "token", "count", "pct", "notes"))
    return heads.unionByName(rows.select("place", (F.col("rank") + n - 1).alias("line_no"), line.alias("text")))


def under_represented_lines(totals: DataFrame, least: int = 1000) -> DataFrame:
    """The classes with less than ``least`` tokens, fewest first, as lines of Markdown: (line_no, text)."""
    few = under_represented(totals, least).withColumn("place", F.row_number().over(W.Window.orderBy("count", "cat", "subcat")) - 1)  # of a few classes
    line = F.format_string("| %s: %s | %,d | %d | %s |", titled(F.col("cat")), titled(F.col("subcat")), "count", "unique_tokens", "recommendation")
    return _headed(few.select(F.col("place").alias("line_no"), line.alias("text")), "| Category | Total Tokens | Unique | Recommendation |", "|----------|--------------|--------|----------------|")


def rare_lines(totals: DataFrame) -> DataFrame:
    """How many tokens are hapax legomena or very rare, as lines of Markdown: (line_no, text)."""
    lines = F.array(F.format_string("- **Hapax legomena** (appear once): %d tokens", "hapax"), F.format_string("- **Very rare** (≤10 occurrences): %d tokens", "up_to_10"))
    return hapax(totals).select(F.posexplode(lines).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


def language_lines(entries: DataFrame, by_language: DataFrame, k: int = 30, least: int = 50) -> DataFrame:
    """The ``k`` languages with most tokens, ties by code, and how many have less than ``least`` entries, as lines of Markdown: (line_no, text)."""
    most = language_statistics(entries, by_language).orderBy(F.desc("tokens"), "language_code").limit(k)
    ranked = most.withColumn("line_no", F.row_number().over(W.Window.orderBy(F.desc("tokens"), "language_code")) - 1)  # of k rows
    line = F.format_string("| %s | %s | %,d | %,d | %d |", "name", "language_code", "entries", "tokens", "unique_tokens")
    table = _headed(ranked.select("line_no", line.alias("text")), "| Language | Code | Entries | Tokens | Unique Tokens |", "|----------|------|---------|--------|---------------|")
    few = low_resource(entries, least).agg(F.count(F.lit(1)).alias("n"))
    return table.unionByName(few.select(F.lit(k + 2).cast("long").alias("line_no"), F.format_string(f"### Languages with Minimal Data (<{least} entries): %d", "n").alias("text")))
