import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoframe.llm import language, licenses, quality, queries, urls
from tests.conftest import SF

DOCS = "doc_id long, text string"


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_statistics(spark):
    rng = random.Random(0)
    parts = ["a", "b", "c", "é", " ", "  ", "\n", "\t", "\x0b", "\xa0", "\x1c", "#", "|", "line\n", "the cat sat "]
    texts = [None, "", "\n\n", "a b c a b c", "x x x x"] + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], f"{DOCS}, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(df, labels).collect()}
    for i, t in enumerate(texts):
        want = brute_statistics(t)
        assert tuple(got[i][c] for c in quality.BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed)
    assert quality.quality(df.limit(0), labels).count() == 0


def test_rules_find_what_is_bad_and_keep_what_is_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels).join(labels, "doc_id").toPandas()
    fine = got[~got.base_failed]
    assert fine[fine.quality == 1].kept.mean() > 0.98
    assert fine[fine.quality == 0].kept.mean() < 0.2


def test_learned_rules_are_conjunctions():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(4000), "b": rng.random(4000), "c": rng.random(4000)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.4)
    rules = quality.learn_rules(x, bad)
    hit = np.logical_or.reduce([quality.covered(r, x) for r in rules])
    assert (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()
    assert {t.name for r in rules for t in r} <= {"a", "b"}
    assert quality.learn_rules(x, np.zeros(4000, bool)) == []


def test_language_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + i, t, g) for i, (t, g) in enumerate([(None, "en"), ("", "en"), ("123 !", None), ("naïve", None), ("the and of " * 9000, None)])], docs.schema)
    got = {r["doc_id"]: r for r in language.identify(docs.unionByName(more)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [k for k in truth if got[k]["held_out"]]
    assert len(held) > 20 and np.mean([got[k]["lang_pred"] == truth[k] for k in held]) > 0.95
    assert [got[10**9 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[10**9]["score"] == 0
    assert got[10**9 + 4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (None, "abc", None)], f"{DOCS}, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(df).collect()} == {("und", 0.0)}


LANG = "doc_id long, text string, lang string"


def prose(rng, n, letters):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def test_language_samples_are_bounded_whatever_the_keys_are(spark):
    """Null keys, one key for all, and one row many times: every language is learned from, with a bounded number of rows."""
    rng = random.Random(3)
    rows = [(None if i % 2 else 7, prose(rng, 30, "aeionrst" if g == "en" else "öäüßkzwg"), g) for i in range(1500) for g in ("en", "de")]
    rows += [(7, "the same row " * 5, "en")] * 900
    df = spark.createDataFrame(rows, LANG)
    got = language.training_rows(df, F.lit(True), per_language=100)
    n = Counter(r[0] for r in got)
    assert n == {"en": 100, "de": 100}
    assert [r[0] for r in got] == [r[0] for r in language.training_rows(df.repartition(7), F.lit(True), per_language=100)]
    x = df.withColumnsRenamed({"doc_id": "id"}).withColumns({"doc_id": F.lit(3).cast("long"), "p": F.lit(1), "score": F.lit("s"), "held_out": F.lit("h"), "draw": F.lit(1), "n": F.lit(1)})
    out = language.identify(x, "id").groupBy("lang_pred").count().collect()
    assert sum(r["count"] for r in out) == len(rows) and {r["lang_pred"] for r in out} == {"en", "de"}
    assert language.identify(df.limit(0)).count() == 0


def test_votes_are_those_of_the_stored_machines(spark):
    """A plain vote over the families, then over the family's languages, by the stored weights and biases."""
    rng = random.Random(5)
    letters = {"en": "aeionrst", "de": "öäüßkzwg", "fr": "éèçaulm", "es": "ñáíodpq", "it": "zgibcfvh"}
    rows = [(g, *[(at := np.flatnonzero(f := language.frequencies(prose(rng, 40, c)))), f[at].astype(np.float32)]) for g, c in letters.items() for _ in range(40)]
    model = language.fit(rows)

    def vote(machines, text):
        x = language.frequencies(text)
        votes, margins = Counter(dict.fromkeys(machines.names, 0)), Counter(dict.fromkeys(machines.names, 0.0))
        for (a, b), w, c in zip(machines.pairs, machines.weights, machines.bias, strict=True):
            m = float(w.astype(float) @ x + c)
            votes[machines.names[a if m >= 0 else b]] += 1
            margins[machines.names[a]] += m
            margins[machines.names[b]] -= m
        return max(machines.names, key=lambda n: (votes[n], margins[n]))

    for g, c in letters.items():
        for _ in range(20):
            text = prose(rng, rng.randint(1, 60), c + letters["en"])
            family = vote(model.families, text)
            got, score = model.predict(text)
            assert got == vote(model.within[family], text) and 0 <= score <= 1
    assert model.predict(None) == model.predict("12 ²") == ("und", 0.0)


def test_rules_on_held_out_labels(spark):
    """Learned from the labels of two thirds of the documents, judged on the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    rules = quality.learn(docs, labels.filter(~held))
    got = quality.judge(docs.join(labels.filter(held), "doc_id"), rules).select("quality", "_quality.*").toPandas()
    fine = got[~got.base_failed]
    assert len(fine[fine.quality == 0]) > 20
    assert fine[fine.quality == 1].kept.mean() > 0.98
    assert fine[fine.quality == 0].kept.mean() < 0.3


def test_verdict_is_the_first_rule_that_fits(spark):
    long_text = "word, " * 200_000 + "!!!"
    texts = [None, "", long_text, "a # b " * 60, "Plain words " * 40 + "here and there"] * 2
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], DOCS)
    rules = [(quality.Test("symbols_per_word", True, 0.3),), (quality.Test("upper_share", False, 0.5), quality.Test("ends_per_word", True, 1e-6))]
    for r in quality.judge(df, rules).select("doc_id", "text", "_quality.*").collect():
        words, _, symbols, _, repeat = brute_statistics(r["text"])
        upper, ends = len(re.findall("[A-Z]", r["text"] or "")), len(re.findall("[!?]", r["text"] or ""))
        letters = len(re.findall("[A-Za-z]", r["text"] or ""))
        want = 1 if symbols / max(words, 1) >= 0.3 else 2 if upper / max(letters, 1) <= 0.5 and ends / max(words, 1) >= 1e-6 else 0
        failed = words < 50 or 100 * repeat > 50 * words
        assert (r["rule"], r["base_failed"], r["kept"]) == (want, failed, not failed and want == 0)


def test_families():
    assert language.family("en") == language.family("de") == "germanic" and language.family("xx") == "xx"


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://a.www.example.com/en/", "http://example.com/EN/", "http://example.com/en/casino?x#y", "http://example.net/es/", "http://net/fr/", "http://notnet/fr/", "http://xnet/fr/", "ftp://a.org://b/c", "http://casino.example.org/", "http://a.org/?q=casino", "http://mycasino.org/", "http://a.com", "http://a.com?x", "http://a.com:80/", "http://a.org/free-bets.html", "x://É.com/É/", "http://a.com/\nen", "http://adult-x.org/", "http://a.b.com/x"]


def brute_url(url):
    url = url or ""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
    rules = {"com/": ("com", "/", "allow"), "example.com/en/": ("example.com", "/en/", "block"), "www.example.com/en/": ("www.example.com", "/en/", "allow"), "net/es/": ("net", "/es/", "block"), "net/fr/": ("net", "/fr/", "block")}
    fits = [n for n, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = url.translate({i: i + 32 for i in range(65, 91)})
    pattern = next((r.name for r in urls.PATTERN_RULES if re.search(r.pattern, low)), None)
    best = max(fits, key=len, default=None)
    return host, path, best, rules[best][2] if best else "block" if pattern else "allow", pattern


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, token string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS * 2)}
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_many_rules_are_read_from_the_index(spark, monkeypatch):
    monkeypatch.setattr(urls, "CONSTANT_RULES", 0)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(df).collect()} == {i: brute_url(u) for i, u in enumerate(URLS)}


def test_a_rule_needs_its_tokens_in_its_pattern():
    with pytest.raises(ValueError, match="no literal token"):
        urls.Rule("x", "block", "(^|[^a-z0-9])casinos([^a-z0-9]|$)", ("casino",), True)


def test_a_rule_without_tokens_is_always_tried(spark):
    extra = urls.Rule("digits", "block", r"[0-9]{3}", (), True)
    df = spark.createDataFrame([(1, "http://a.org/x123"), (2, "http://a.org/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, pattern_rules=(*urls.PATTERN_RULES, extra)).collect()}
    assert got == {1: "block", 2: "allow"}


LISTS = "host string, path string, pattern string, verdict string"


@pytest.mark.parametrize("constants", [0, 200])
def test_rules_of_a_callers_table(spark, monkeypatch, constants):
    monkeypatch.setattr(urls, "CONSTANT_RULES", constants)
    rows = [("Example.com", "/en/", None, "block"), ("example.com", "/en/", None, "block"), ("www.example.com", "/en/", "", "allow"), ("org", None, None, "block")]
    rows += [(None, None, r"\bfree-bets\b", "block"), ("", None, "x[0-9]+y", "block"), *[(f"h{i}.net", "/p", None, "block") for i in range(250)]]
    hosts, patterns = urls.rules_from(spark.createDataFrame(rows, LISTS))
    assert len(hosts) == 253 and [r.tokens for r in patterns] == [("free", "bets"), ()]
    seen = {"http://a.example.com/en/x": "block", "http://www.example.com/en/": "allow", "http://h7.net/pq": "block", "http://h7.net/q": "allow", "http://b.org/": "block", "http://c.io/free-bets": "block", "http://c.io/free-betsy": "allow", "http://c.io/x12y": "block"}
    df = spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(df, host_rules=hosts, pattern_rules=patterns).collect()}
    assert got == dict(enumerate(seen.values()))


@pytest.mark.parametrize("row", [(None, None, None, "block"), ("a.com", "/", "x", "block"), ("a.com", "/", None, "deny"), (None, None, "x", "allow")])
def test_rows_that_are_no_rule_are_refused(spark, row):
    with pytest.raises(ValueError, match="no rule"):
        urls.rules_from(spark.createDataFrame([row], LISTS))


def test_every_match_has_the_tokens_of_its_pattern():
    rng = random.Random(3)
    part = lambda k: "".join(rng.choices(["a", "b", "1", "-", "/", "_", r"\.", r"\b", "^", "$", "[ab]", "a+", "|"], [6, 6, 3, 3, 3, 1, 2, 1, 1, 1, 1, 1, 1], k=k))
    some = 0
    for _ in range(100_000):
        pattern, url = part(rng.randint(1, 5)), "".join(rng.choices("ab1-/_.", k=rng.randint(0, 12)))
        tokens = urls.literal_tokens(pattern)
        if tokens and re.search(pattern, url):
            some += 1
            assert set(tokens) <= set(re.findall("[a-z0-9]+", url)), (pattern, url)
    assert some > 20


def test_templates_of_a_callers_table(spark, monkeypatch):
    rows = [("own", "one two three four five six seven"), ("own", "you may look at this text and at nothing else"), ("own", "one two three four five six seven"), ("b", "a b c d e f g h i")]
    table = spark.createDataFrame(rows, "license string, text string")
    templates = licenses.templates_from(table)
    assert templates == {"b": rows[3][1], "own": rows[0][1], "own#2": rows[1][1]}
    docs = spark.createDataFrame([(1, "x " + rows[1][1] + " y"), (2, "x")], DOCS)
    assert [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs, templates).collect()] == [(1, "own#2")]
    for bad in [(None, "a b"), ("c", None), ("c", " ! ")]:
        with pytest.raises(ValueError, match="name and words"):
            licenses.templates_from(spark.createDataFrame([bad], "license string, text string"))
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 10)
    with pytest.raises(ValueError, match="every task"):
        licenses.templates_from(table)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def plain_shingles(text):
    w = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_licenses(text):
    s = plain_shingles(text)
    sets = {n: plain_shingles(t) for n, t in licenses.TEMPLATES.items()}
    return {n for n, t in sets.items() if len(s & t) >= licenses.CONTAINMENT * len(t)}


def test_licenses(spark):
    rng = random.Random(0)
    filler = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "is", "of"], k=rng.randint(0, 400)))
    texts = [None, "", "license", *(f"{filler()} {t.upper() if i % 2 else t} {filler()}" for i, t in enumerate(licenses.TEMPLATES.values()))]
    mit = licenses.TEMPLATES["mit"].split()
    texts += [" ".join(mit[:30]), " ".join(w for i, w in enumerate(mit) if i != 40), filler() + " " + licenses.TEMPLATES["mit-line"] + " " + filler() + " " + licenses.TEMPLATES["mit-line"], "word " * 40000 + licenses.TEMPLATES["bsd"]]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], f"{DOCS}, license string")
    found = {}
    for r in licenses.scan_licenses(df).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert licenses.scan_licenses(df.unionByName(df.filter("doc_id > 5"))).count() == sum(len(r) * (1 + (i > 5)) for i, r in found.items())
    assert {i: {r["license"] for r in found.get(i, [])} for i in range(len(texts))} == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert sum(r["license"] == "mit-line" for r in found[len(texts) - 2]) == 2
    for i, rs in found.items():
        words = licenses.words_of(texts[i])
        for r in rs:
            part = set(licenses.shingles(words[r["first_word"] : r["first_word"] + r["n_words"]]).tolist())
            want = set(licenses.shingles(licenses.words_of(licenses.TEMPLATES[r["license"]])).tolist())
            assert abs(len(part & want) / len(want) - r["containment"]) < 1e-9
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_rules_are_learned_from_small_batches(spark, monkeypatch):
    """Learning is a job of its own: few whole texts go to Python at once there too, and the session's setting is as it was."""
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "toPandas", _noted(kind.toPandas, lambda: seen.append(spark.conf.get(name))))
    docs = spark.createDataFrame([(i, "word " * 60) for i in range(20)], "doc_id long, text string")
    quality.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"))
    assert seen == ["1000"] and spark.conf.get(name) == before


def _noted(f, note):
    def of(*args, **kwargs):
        note()
        return f(*args, **kwargs)

    return of
