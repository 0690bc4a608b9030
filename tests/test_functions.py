import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonoframe.functions import ipa
from phonoframe.operators import stats


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


TOKENS = [
    ("t͡ʃʰ", ["t͡ʃʰ"]), ("ˈba.na.na", list("ˈba.na.na")), ("d͡ʒ", ["d͡ʒ"]), ("aː", ["a", "ː"]), ("ˈʱa", ["ˈʱ", "a"]), ("a˥˩", ["a˥˩"]),
    ("x³", ["x", "³"]), ("kʼatʼ", ["kʼ", "a", "tʼ"]), ("bɔ̃ d", ["b", "ɔ̃", "d"]), ("̃a", ["̃", "a"]), ("a\xa0b", ["a", "b"]), ("", []), (None, None),
]


def test_n2_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", ipa.tokenize(F.col("t")).alias("x")).collect()}
    assert got == {i: want and [unicodedata.normalize("NFD", w) for w in want] if want else want for i, (_, want) in enumerate(TOKENS)}


def test_n1_normalize(spark):
    assert one(spark, "[g:'ã]", ipa.normalize_ipa) == "ɡːˈã"
    assert one(spark, "  /a͜b/ ", ipa.normalize_ipa) == "a͡b"
    assert one(spark, None, ipa.normalize_ipa) is None


@pytest.mark.parametrize(("token", "want"), [("ç", ("consonant", "plosive")), ("a̰", ("vowel", "nasalized")), ("t͡ʃ", ("consonant", "affricate")), ("kʼ", ("consonant", "ejective")), ("ǃ", ("consonant", "click")), ("ɓ", ("consonant", "implosive")), ("³", ("other", "unknown")), ("-", ("boundary", "syllable/word")), ("a˥˩", ("suprasegmental", "tone")), ("ʰ", ("modifier", "secondary articulation"))])
def test_n8_fine_category(spark, token, want):
    assert tuple(one(spark, token, ipa.fine_category)) == want


def test_n11_rating(spark):
    rows = spark.createDataFrame([(n,) for n in (10000, 9999, 999, 99, 9)], "n long")
    assert [r[0] for r in rows.select(ipa.coverage_rating(F.col("n"))).collect()] == ["Excellent", "Good", "Limited", "Poor", "Minimal"]


def test_n4_n5_n13_names(spark):
    rows = spark.createDataFrame([("ABQ", 7), ("ABQ", None), ("ABQ", 1234)], "c string, n int")
    assert [r[0] for r in rows.select(ipa.entry_id(F.col("c"), F.col("n"))).collect()] == ["abq_007", "abq_000", "abq_1234"]
    assert one(spark, "a/b/c.d.wav", ipa.file_stem) == "c.d"
    assert one(spark, "runs/checkpoint_120.pth", ipa.artefact_step) == 120
    assert one(spark, "best_model.pth", ipa.artefact_step) == 0
    assert one(spark, "last.pth", lambda c: ipa.artefact_step(c, True)) is None


def test_n9_code_points(spark):
    assert one(spark, "ã𝄞", ipa.code_points) == "U+0061 U+0303 U+1D11E"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abɔʃt͡ʰː ˈ.̃g5-", max_size=12), min_size=1, max_size=30))
def test_tokens_give_the_text_back(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", ipa.normalize_ipa(F.col("t")))
    for r in rows.select("n", F.array_join(ipa.tokenize(F.col("n"), False), "").alias("x"), ipa.normalize_ipa(F.col("n")).alias("again")).collect():
        assert r["x"] == "".join(r["n"].split())
        assert r["again"] == r["n"]


def test_n1_white_space_inside_takes_linear_time(spark):
    """Half a million blanks inside are kept, all kinds outside go."""
    inside = "a" + " " * 500_000 + "b"
    assert one(spark, "\u2003\xa0\n" + inside + "\u3000\x85 ", ipa.strip) == inside
    assert one(spark, "\u200b\x1cx\x1f", ipa.strip) == "\u200b\x1cx\x1f"


ODD = "abgzé:'\u0303\u0300\u035c\u0361ːˈˌʰʷ˞.[]/() \t\u00a0\u2000\u3000-1٣ñ한ɐ◌©\n\u1e8d\u0345"


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)] + [None, "", " ", "\u0303", "a" * 5000]


def test_tokens_are_counted_without_a_list(spark):
    df = spark.createDataFrame([(t,) for t in odd_texts(2000)], "t string")
    assert df.filter(~ipa.token_count(F.col("t")).eqNullSafe(F.size(ipa.tokenize(F.col("t"))))).count() == 0


def test_tokens_are_counted_by_edges(spark):
    """Any text, long runs of ASCII and marks at their ends; every length of a step is that of the list."""
    rng = random.Random(5)
    ends = ["e\u0301", "t\u0361s", "t\u035cs\u0303", "k\u02b0", ":\u0303", "'\u0301", "\u00e9", "\uac01", "\u00a0", "\u0303", "\u02c8a", "[", "/\u0301", " \u0301", "g\u0323\u0307", "\u1e9b\u0323", "\u212b", "\u2000"]
    texts = ["".join(rng.choice([*ends, "abc", "x: y", "a b\tc\n", "q"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "ipa string")
    want = df.select(F.size(ipa.tokenize(F.col("ipa"))).alias("length"))
    got = stats.token_lengths(df)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert df.filter(~ipa.token_count(F.col("ipa")).eqNullSafe(F.size(ipa.tokenize(F.col("ipa"))))).count() == 0


def test_lengths_are_made_once(spark):
    """All parts of the histogram read stored lengths; texts meet Python once, as edges."""
    df = spark.createDataFrame([("abcde fgh\u00e9",), ("",), (None,)], "ipa string")
    plan = stats.length_histogram(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "nfd(" not in plan and "regexp_replace" not in plan
    assert ipa.INNER in stats.token_lengths(df)._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_before_tokens(spark):
    """Equal to a count of each token, and each distinct word meets the token grammar once."""
    df = spark.createDataFrame([(f"L{i % 3}", t) for i, t in enumerate(odd_texts(2000))], "language_code string, ipa string")
    want = stats.token_table(df, "language_code").groupBy("language_code", "token").agg(F.count(F.lit(1)).alias("count"))
    got = stats.language_tokens(df)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("_word")  # plans are written from the top


def test_long_words_are_cut_where_no_token_is(spark):
    """Texts without white space reach Python in pieces; what they hold is that of the whole text."""
    rng = random.Random(7)
    odd = ["".join(rng.choice(ODD.replace(" ", "").replace("\n", "") + "abcé한'") for _ in range(1500)) for _ in range(60)]
    tied = ["a" * (ipa.WORD_CHARS - 2 + i) + m + "b" * 300 for i in range(4) for m in ("t\u0361", "t\u0361\u0301[", "t\u035c]", "\u0323\u0301", "\u02b0", "/\u0301", "\u0301" * 40 + "\u0361", "\u0361" + "\u0301" * 40)]
    long = ["é" * 5000, "\u0e01\u0e34" * 3000, "e\u0301" * 3000, "-" * 3000, "٣" * 3000, "\U00020000" * 3000, "[" * 3000, "\u0301" * 3000]
    df = spark.createDataFrame([("L", t) for t in [*odd, *tied, *long]], "language_code string, ipa string")
    want = stats.token_table(df, "language_code").groupBy("language_code", "token").agg(F.count(F.lit(1)).alias("count"))
    got = stats.language_tokens(df)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    cut = spark.createDataFrame([(t,) for t in long[:-1]], "t string").select(F.explode(ipa.pieces(F.col("t"))).alias("p"))
    assert cut.filter(F.length("p") > ipa.WORD_CHARS + 1).count() == 0
    assert "_piece" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["n7_coarse_category", "n11_coverage_rating", "g11_language_statistics", "v1_token_frequency", "g7_merged_sketches"])
def test_queries_cut_long_words(spark, tmp_path, name):
    """A query on texts that are one long word each sends no word whole to the decomposition."""
    from phonoframe.plans import registry

    rows = [(i, "t\u0361s\u00e9a\u02d0" * 400 + "z" * i, "en", "web", 1) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    assert "_piece" in df._jdf.queryExecution().optimizedPlan().toString() and df.count() > 0


@pytest.mark.parametrize("name", ["n7_coarse_category", "n11_coverage_rating"])
def test_queries_cut_words_without_letters(spark, tmp_path, monkeypatch, name):
    """No long word of symbols meets the decomposition whole; here that only looks at lengths, as these characters are decomposed already."""
    from phonoframe.plans import registry

    monkeypatch.setattr(ipa, "nfd", lambda text: F.when(F.length(text) > ipa.WORD_CHARS + 1, F.raise_error(F.lit("a long word"))).otherwise(text))
    rows = [(i, "\u2701\u201c\u20ac" * 400, "en", "web", 1) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {(c, "consonant") if name[1] == "7" else (c, 1200, "Good") for c in "\u2701\u201c\u20ac"}


def test_words_without_letters_are_cut(spark):
    """Symbols, dingbats, stress and length marks and punctuation beyond ASCII are cut too, with the tokens of the whole word; so are mixtures with marks, modifiers and tie bars."""
    same = ["\u2701", "\u2200", "\u201c", "\u3002", "\u20ac", "\u02d0", "\u02c8", "\u02e5", "\U0001f600", "\ue000", "\u200d"]
    short = [c for c in same if c != "\u02e5"]  # tone letters go with a base before them, they are not cut
    rng = random.Random(11)
    mixed = ["".join(rng.choice("\u2701\u201c\u20ac\u02d0\u02c8\u02b0\u0374\u0361\u035c\u0301\u0323\u3002[:'\u00a8\u0385") for _ in range(1500)) for _ in range(60)]
    df = spark.createDataFrame([("L", t) for t in [*(c * 3000 for c in same), *mixed]], "language_code string, ipa string")
    want = stats.token_table(df, "language_code").groupBy("language_code", "token").agg(F.count(F.lit(1)).alias("count"))
    got = stats.language_tokens(df)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    cut = spark.createDataFrame([(c * 3000,) for c in short], "t string").select(F.explode(ipa.pieces(F.col("t"))).alias("p"))
    assert cut.filter(F.length("p") > ipa.WORD_CHARS + 1).count() == 0


def test_java_cuts_before_no_mark_and_no_modifier(spark):
    """Of all characters: each before which Java cuts begins, decomposed, with none that a token before it takes or that order moves."""
    points = spark.createDataFrame([(chr(i),) for i in [*range(1, 0xD800), *range(0xE000, 0x110000)]], "c string")
    before = [r["c"] for r in points.filter(F.col("c").rlike("^" + ipa._CUT)).collect()]
    assert len(before) > 250_000
    for c in before:
        first = unicodedata.normalize("NFD", c)[0]
        assert unicodedata.combining(first) == 0 and unicodedata.category(first)[0] != "M", hex(ord(c))
        assert not "\u02b0" <= first <= "\u02ff" or first in "\u02c8\u02cc\u02d0\u02d1", hex(ord(c))


def test_what_a_cut_is_before_starts_a_token():
    """Of all characters: decomposed, one that may be cut before is no mark and no modifier, and no other than tie bars has one."""
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        kind, whole = unicodedata.category(c), unicodedata.normalize("NFD", c)
        assert c in "\u035c\u0361" or not {"\u035c", "\u0361"} & set(whole)
        if kind == "Nd" or kind[0] == "L" and kind != "Lm" or c < "\x80":
            assert unicodedata.combining(whole[0]) == 0 and unicodedata.category(whole[0])[0] != "M" and not "\u02b0" <= whole[0] <= "\u02ff", hex(ord(c))


def test_classes_are_found_for_distinct_tokens_alone(spark):
    """No filter by class goes below the counts of tokens."""
    df = spark.createDataFrame([("L", "a\u0301b. -")], "language_code string, ipa string")
    few = stats.under_represented(stats.token_totals(stats.language_tokens(df)))
    assert {(r["cat"], r["subcat"], r["unique_tokens"], r["count"]) for r in few.collect()} == {("vowel", "oral", 1, 1), ("consonant", "plosive", 1, 1)}
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "suprasegmental" not in plan[plan.index("Aggregate [language_code") :]


def test_decomposition_works_on_slices(monkeypatch):
    """A batch of long texts isn't held as Python strings at once."""
    monkeypatch.setattr(ipa, "TEXT_BYTES", 100)
    texts = pa.array(["é" * 60, None, "", "a", "b" * 90, "c" * 300])
    some = list(ipa._slices(texts))
    assert pa.concat_arrays(some).equals(texts) and [len(s) for s in some] == [1, 4, 1]
