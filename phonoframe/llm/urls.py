"""URL filters: pattern rules found by their rarest literal token, all in Spark expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A pattern over host + path, or over the whole lower-cased URL if ``anywhere``.

    ``tokens`` are literal tokens (maximal runs of a-z and 0-9) that every match has. A rule
    without one is tried on every URL. A token that isn't in the pattern as it stands is refused, as the index would
    lose matches by it.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    anywhere: bool = False

    def __post_init__(self):
        plain = re.sub(r"\\(.)", r"\1", re.sub(r"\[[^\]]*\]|\\b", " ", self.pattern))
        for t in self.tokens:
            if not re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", plain.lower()):
                raise ValueError(f"rule {self.name}: {t} is no literal token of {self.pattern}")

    @staticmethod
    def of_host(host: str, path: str, verdict: str) -> Rule:
        """A host with all its subdomains, and how the path starts."""
        whole_path = path if re.fullmatch(r".*[^A-Za-z0-9]", path) else re.sub(r"[A-Za-z0-9]+$", "", path)
        tokens = tuple(re.findall(_TOKEN, f"{host} {whole_path.lower()}"))
        escape = lambda s: re.sub(r"([^A-Za-z0-9/_])", r"\\\1", s)
        return Rule(host + path, verdict, rf"^([^/]*\.)?{escape(host)}{escape(path)}", tokens)


#: The rules that hosts and paths are judged by; the longest that fits wins.
HOST_RULES = (
    Rule.of_host("com", "/", "allow"),
    Rule.of_host("example.com", "/en/", "block"),
    Rule.of_host("www.example.com", "/en/", "allow"),
    Rule.of_host("net", "/es/", "block"),
    Rule.of_host("net", "/fr/", "block"),
)
#: What else speaks against a URL.
PATTERN_RULES = (
    Rule("casino", "block", r"(^|[^a-z0-9])casino([^a-z0-9]|$)", ("casino",), True),
    Rule("bets", "block", r"(^|[^a-z0-9])(free|best|live)[^a-z0-9]bets([^a-z0-9]|$)", ("bets",), True),
    Rule("pills", "block", r"(^|[^a-z0-9])(cheap|diet|buy)[^a-z0-9]pills([^a-z0-9]|$)", ("pills",), True),
    Rule("adult", "block", r"(^|[^a-z0-9])adult[^a-z0-9](x|xxx|video|cam)([^a-z0-9]|$)", ("adult",), True),
    Rule("ads", "block", r"(^|[^a-z0-9])ads[^a-z0-9](track|server|click)([^a-z0-9]|$)", ("ads",), True),
    Rule("spam farm", "block", r"(^|[^a-z0-9])spam[^a-z0-9]farm([^a-z0-9]|$)", ("spam", "farm"), True),
)


#: Rules of a list that the driver holds; judging keeps an index of them, which is small beside any crawl.
MOST_RULES = 1_000_000


def rules_from(lists: DataFrame) -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    """(host rules, pattern rules) of a caller's table (host, path, pattern, verdict), for ``judge_urls``.

    A row with a host is a rule for it and its subdomains and for how paths start (null or empty: with /); one with a pattern, which is a regular expression over the
    lower-cased URL, blocks what it is found in. A pattern's literal tokens are the runs of a-z and 0-9 that every match must have, found in patterns without
    groups, classes, choices and repetitions; a pattern without one is tried on every URL. Repeated rows count once; of host rules that differ in the verdict alone, and rows with neither
    or with another verdict than allow and block, the list is refused. Hosts are lower-cased. Rules are ordered by what they say, so that the list's order doesn't matter.
    """
    rows = lists.select("host", "path", "pattern", "verdict").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    hosts: dict[tuple[str, str], str] = {}
    patterns = set()
    for r in rows:
        if bool(r["host"]) == bool(r["pattern"]) or r["verdict"] not in ("allow", "block") or (r["pattern"] and r["verdict"] != "block"):
            raise ValueError(f"no rule: {r}")
        if r["pattern"]:
            patterns.add(r["pattern"])
        elif hosts.setdefault((r["host"].lower(), r["path"] or "/"), r["verdict"]) != r["verdict"]:
            raise ValueError(f"two verdicts: {r}")
    found = tuple(Rule.of_host(h, p, v) for (h, p), v in sorted(hosts.items()))
    return found, tuple(Rule(p, "block", p, literal_tokens(p), True) for p in sorted(patterns))


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The tokens that every match of a pattern has as tokens of the URL; fewer where that isn't plain to see.

    Only patterns of literal letters, digits, escaped punctuation and such punctuation as means itself are looked into, with ``\\b`` or the ends of the URL beside a token.
    """
    if not re.fullmatch(r"(?:\^|\\b)?(?:[a-z0-9/:_=&%~-]|\\[^A-Za-z0-9])+(?:\$|\\b)?", pattern):
        return ()
    plain = re.sub(r"\\([^A-Za-z0-9])", r"\1", re.sub(r"^(\^|\\b)|(\$|\\b)$", " ", pattern))
    # a run at an open end may be a part of a longer token
    return tuple(dict.fromkeys(re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", plain)))


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, _UPPER, _LOWER), F.lit(_TOKEN), F.lit(0)))


def rule_index(spark: SparkSession, rules: list[tuple[int, Rule]], urls: DataFrame) -> DataFrame:
    """(token, rules array): every rule under the one of its tokens that the fewest URLs have.

    ``urls`` has the array column ``tokens``. Its counts come from all URLs, and only of tokens
    that rules have.
    """
    described = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.anywhere, t) for i, r in rules for t in r.tokens], "id int, name string, verdict string, pattern string, anywhere boolean, token string")
    wanted = sorted({t for _, r in rules for t in r.tokens})
    if len(wanted) <= CONSTANT_RULES:
        each = urls.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        listed = described.select("token").distinct()
        each = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(listed) if len(wanted) <= MOST_SENT else listed, "token", "left_semi")
    counts = each.groupBy("token").count()
    rarest = W.Window.partitionBy("id").orderBy(F.coalesce("count", F.lit(0)), "token")
    placed = described.join(counts, "token", "left").withColumn("place", F.row_number().over(rarest)).filter("place = 1")
    return placed.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("id", "name", "verdict", "pattern", "anywhere"))).alias("rules"))


#: Up to so many rules, patterns are constants of the plan, compiled once; more are read from the index.
CONSTANT_RULES = 200
#: Up to so many rules or tokens of rules, lists of them are sent to all tasks; more are joined.
MOST_SENT = 100_000


def _fits(rules: tuple[Rule, ...], place: Column, lowered: Column) -> Column:
    """Whether the pattern of the candidate rule ``r`` is found."""
    if len(rules) > CONSTANT_RULES:
        return F.regexp_like(F.when(F.col("r.anywhere"), lowered).otherwise(place), F.col("r.pattern"))
    out = F.lit(False)
    for i, r in reversed(list(enumerate(rules))):
        out = F.when(F.col("r.id") == i, (lowered if r.anywhere else place).rlike(r.pattern)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES) -> DataFrame:
    """(key, host, path, rule, verdict, pattern) for every row of ``pages``.

    Each distinct URL is judged once. Its tokens fetch candidate rules from the index, and only
    those run their regular expressions. Of the host rules that fit, the longest decides; without
    one, any pattern rule that fits blocks and all else is allowed. ``pattern`` is the first fitting
    pattern rule. Null, empty and odd URLs have an empty host and path and fit no host rule. Other columns are ignored;
    an empty table gives no rows.
    """
    spark, rules = pages.sparkSession, (*host_rules, *pattern_rules)
    first_pattern = len(host_rules)
    urls = pages.select(F.coalesce(url, F.lit("")).alias("url")).distinct().withColumn("tokens", tokens(F.col("url")))
    index = rule_index(spark, [x for x in enumerate(rules) if x[1].tokens], urls)
    index = F.broadcast(index) if len(rules) <= MOST_SENT else index
    found = urls.select("url", F.explode("tokens").alias("token")).join(index, "token").select("url", F.explode("rules").alias("r"))
    always = [(i, r) for i, r in enumerate(rules) if not r.tokens]
    if always:
        each = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.anywhere).alias("anywhere")) for i, r in always])
        found = found.unionByName(urls.select("url", F.explode(each).alias("r")))
    place = F.concat(host(F.col("url")), path(F.col("url")))
    lowered = F.translate("url", _UPPER, _LOWER)
    fits = found.filter(_fits(rules, place, lowered))
    ours = F.col("r.id") < first_pattern
    decided = fits.groupBy("url").agg(
        F.max(F.when(ours, F.struct(F.length("r.name").alias("size"), F.col("r.name").alias("name"), F.col("r.verdict").alias("verdict")))).alias("best"),
        F.min(F.when(~ours, F.struct(F.col("r.id").alias("id"), F.col("r.name").alias("name")))).alias("other"),
    )
    plain = pages.select(F.col(key), F.coalesce(url, F.lit("")).alias("url"))
    return plain.join(decided, "url", "left").select(
        F.col(key),
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("other").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("other.name").alias("pattern"),
    )


def oracle(host_rules: tuple[Rule, ...] = HOST_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES) -> str:
    """The same in DuckDB, every rule tried on every page."""
    place = "host || path"
    best = " ".join(f"when regexp_matches({place}, '{r.pattern}') then '{r.name}'" for r in sorted(host_rules, key=lambda r: -len(r.name)))
    verdict = " ".join(f"when regexp_matches({place}, '{r.pattern}') then '{r.verdict}'" for r in sorted(host_rules, key=lambda r: -len(r.name)))
    other = " ".join(f"when regexp_matches(low, '{r.pattern}') then '{r.name}'" for r in pattern_rules)
    return f"""
    with p as (
      select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
        translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as low
      from pages)
    select page_id, host, path, case {best} end as rule,
      case {verdict} else case when case {other} end is null then 'allow' else 'block' end end as verdict,
      case {other} end as pattern
    from p"""
