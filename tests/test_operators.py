import random
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoframe.functions import ipa
from phonoframe.operators import align, catalog, extract, filters, manifest, ranking, segment, splits, stats, trainlog, vocab
from phonoframe.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_c1_c2_upsert(spark):
    old = spark.createDataFrame([(1, "EN", "a", 2001, True), (2, "EN", "b", 2002, False)], "recording_id long, language_code string, audio_filename string, year int, downloaded boolean")
    new = spark.createDataFrame([("EN", "a", None), ("EN", "c", 2009), ("EN", "c", 2009)], "language_code string, audio_filename string, year int")
    want = [(1, "EN", "a", None, True), (2, "EN", "b", 2002, False), (3, "EN", "c", 2009, None)]
    once = catalog.upsert_recordings(old, new)
    assert rows(once) == want
    assert rows(catalog.upsert_recordings(once, new)) == want


def test_c3_empty_new_list_leaves_old_rows(spark):
    old = spark.createDataFrame([(1, 10), (2, 20)], "recording_id long, n int")
    assert rows(catalog.replace_of(old, old.filter("false"))) == [(1, 10), (2, 20)]
    assert rows(catalog.replace_of(old, spark.createDataFrame([(1, 11), (1, 12)], "recording_id long, n int"))) == [(1, 11), (1, 12), (2, 20)]


@pytest.mark.parametrize(("silent", "duration", "want"), [([(5, 6), (9, None)], 10, [(0, 5), (6, 9), (6, 10)]), ([(0, 1), (4, 6)], 10, [(1, 4), (6, 10)]), ([], 7, [(0, 7)])])
def test_t2_complement(spark, silent, duration, want):
    s = spark.createDataFrame([("k", a, b) for a, b in silent], "k string, start long, end long")
    d = spark.createDataFrame([("k", duration)], "k string, duration long")
    assert sorted((r["start"], r["end"]) for r in segment.regions(s, d, "k").collect()) == want


def test_t2_open_silence_without_tail(spark):
    s = spark.createDataFrame([("k", 5, 6), ("k", 9, None)], "k string, start long, end long")
    d = spark.createDataFrame([("k", 10)], "k string, duration long")
    assert sorted((r["start"], r["end"]) for r in segment.regions(s, d, "k", unterminated="silent").collect()) == [(0, 5), (6, 9)]


def test_t4_against_a_loop(spark):
    rng = random.Random(4)
    grids = {k: (rng.randint(0, 15), [rng.randint(0, 30) for _ in range(12)]) for k in range(200)}
    found = spark.createDataFrame([(k, i, n) for k, (_, ns) in grids.items() for i, n in enumerate(ns)], "k int, idx int, n int")
    targets = spark.createDataFrame([(k, t) for k, (t, _) in grids.items()], "k int, target int")
    got = {r["k"]: r["idx"] for r in segment.choose(found, targets, "k").collect()}
    for k, (t, ns) in grids.items():
        near = [i for i, n in enumerate(ns) if abs(n - t) <= 2]
        assert got[k] == (near[0] if near else min(range(12), key=lambda i: (abs(ns[i] - t), i)))


def test_t6_mismatch(spark):
    df = spark.createDataFrame([(13, 10), (14, 10)], "n int, t int")
    assert [r[0] for r in df.select(segment.counts_differ(F.col("n"), F.col("t"))).collect()] == [False, True]


def test_t1_tones_in_a_wav_file(spark):
    tone, quiet = [0.5, -0.5] * 1600, [0.0] * 1600
    w = spark.createDataFrame([("a", tone + quiet * 2 + tone + quiet + tone), ("b", quiet * 4)], "rec_id string, x array<double>").select("rec_id", readers.wav(F.col("x"), F.lit(8000)).alias("content"))
    w = w.unionByName(spark.createDataFrame([("c", bytearray(b"RIFF"))], "rec_id string, content binary"))
    entries = spark.createDataFrame([("a", i, n) for i, n in enumerate((None, 2, 3))] + [("c", 9, 1)], "rec_id string, entry_id int, entry_number int")
    made, status = segment.segment_all(readers.pcm_frames(w), entries, "rec_id")
    assert [(r["entry_id"], r["start_ms"], r["end_ms"]) for r in made.orderBy("ordinal").collect()] == [(0, 0, 500), (1, 700, 1800)]  # two are near enough to three
    assert {r["rec_id"]: r["status"] for r in status.collect()} == {"a": 2, "b": 0, "c": -1}


def test_places_with_long_shared_prefixes(spark):
    """Keys that begin alike are cut to parts of which none has more than twice its share."""
    n = 6000
    df = spark.createDataFrame([("EN" if i % 6 else None, f"en_word-list_2009_{i * 7919 % n:06d}") for i in range(n)], "g string, k string")
    got = ranking.places(df, ["g"], ["k"]).collect()
    for g in ("EN", None):
        own = sorted((r["k"], r["place"], r["_size"]) for r in got if r["g"] == g)
        assert [x[1] for x in own] == list(range(1, len(own) + 1)) and {x[2] for x in own} == {len(own)}
    one = ranking.places(df, [], ["g", "k"])
    assert sorted(r["place"] for r in one.collect()) == list(range(1, n + 1))
    assert ranking.places(df.limit(0), ["g"], ["k"]).count() == 0


@pytest.mark.parametrize("keys", ["1", "id % 3", "if(id % 10 = 0, id, -1)"])
def test_parts_follow_the_rows_and_cut_ties(spark, monkeypatch, keys):
    """A million rows of one key, or of few, are spread over all parts, whose number is not fixed."""
    monkeypatch.setattr(ranking, "PART_ROWS", 20_000)
    n = 1_000_000
    placed = ranking.parted(spark.range(n).selectExpr("'x' as g", f"{keys} as k"), ["g"], ["k"], n)
    counts = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(counts) == 50 and max(counts) <= 2 * n / 50 and sum(counts) == n
    assert [ranking.part_count(k, 8) for k in (0, 1, 5000, 10**9)] == [1, 1, 2, 50_000]


def test_places_of_ties(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW_ROWS", 50)
    n = 3000
    rows = [("a" if i % 3 else None, None if i % 4 else i % 7) for i in range(n)]
    got = ranking.places(spark.createDataFrame(rows, "g string, k int"), ["g"], ["k"]).collect()
    for g in ("a", None):
        own = sorted((r["place"], r["k"]) for r in got if r["g"] == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and {r["_size"] for r in got if r["g"] == g} == {len(own)}
        keys = [(k is not None, k or 0) for _, k in own]
        assert keys == sorted(keys)


@pytest.mark.parametrize("most", [20, 10_000])
def test_quantiles_of_many_values_and_ties(spark, monkeypatch, most):
    """Nine tenths of the values are equal; ranges of the others are counted, level by level, where there are more than one task may order."""
    monkeypatch.setattr(ranking, "SORTED", most)
    monkeypatch.setattr(ranking, "FINER", 4)
    r = np.random.default_rng(2)
    values = {"a": np.where(r.random(20_000) < 0.9, 7.25, r.normal(0, 1e9, 20_000)), None: r.normal(size=3000).round(2), "c": np.exp(r.normal(0, 50, 500)), "d": np.array([2.5, -2.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    shares = {"low": 0.0, "a": 0.05, "m": 0.5, "b": 0.951, "high": 1.0}
    got = {x["k"]: [x[c] for c in shares] for x in ranking.quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k] == pytest.approx([float(np.quantile(vs, q)) for q in shares.values()], rel=1e-9)
    assert ranking.quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()[0:1] in ([], [(None,)])


def test_quantiles(spark):
    values = {"a": [3.0, 1.0, 2.0, 10.0], "b": [5.0], "c": [1.0, 1.0, 4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    got = {r["k"]: (r["m"], r["q"]) for r in ranking.quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.95}).collect()}
    for k, vs in values.items():
        assert got[k] == pytest.approx((float(np.quantile(vs, 0.5)), float(np.quantile(vs, 0.95))))


@pytest.mark.parametrize("n", [1, 9, 10, 25, 700])
def test_x1_sizes_and_order(spark, n):
    df = spark.createDataFrame([("EN", f"clip_{i:05d}") for i in range(n)], "language_code string, segment_key string")
    got = splits.stratified(df).orderBy("segment_key").collect()
    val = splits.validation_rows(n)
    assert [r["split"] for r in got] == ["train"] * (n - val) + ["val"] * val


def test_p3_durations(spark):
    df = spark.createDataFrame([("1500",), ("300",), ("299",), ("15000",), ("abc",), (None,)], "duration_ms string")
    assert [r[0] for r in df.filter(filters.in_duration()).collect()] == ["1500", "300", "15000"]


def test_k1_s3_escapes(spark, tmp_path):
    texts = ['a|b\\c"d', "x\\", "\\n", "two\nlines", "", "a\\|b"]
    df = spark.createDataFrame([(f"wavs/{i}.wav", t, "ENG") for i, t in enumerate(texts)], "audio_file string, text string, speaker_name string")
    columns = ["audio_file", "text", "speaker_name"]
    sinks.write_pipe_manifest(df, str(tmp_path / "m"), columns)
    lines = {r[0] for r in spark.read.text(str(tmp_path / "m/*")).collect()}
    assert 'wavs/0.wav|a\\|b\\\\c\\"d|ENG' in lines
    back = readers.pipe_manifest(spark, str(tmp_path / "m/*"), columns)
    assert {r["audio_file"]: r["text"] for r in back.collect()} == {f"wavs/{i}.wav": t for i, t in enumerate(texts)}


def test_d2_frames(spark):
    df = spark.createDataFrame([(0.0, 0.10), (0.0, 0.05), (0.0, 0.005)], "a double, b double")
    assert [r[0] for r in df.select(align.frames(F.col("a"), F.col("b"))).collect()] == [8, 4, 1]


def test_d1_tiers(spark):
    grid = 'item []:\n    item [1]:\n        name = "{}"\n            xmin = 0\n            xmax = 0.1\n            text = "a" \n            xmin = 0.1\n            xmax = 0.2\n            text = "" \n            xmin = 0.2\n            xmax = 0.5\n            text = "b""c" \n'
    df = spark.createDataFrame([("w", grid.format("words")), ("p", grid.format("phones")), ("n", grid.format("other")), ("z", None)], "audio_id string, content string")
    got = {r["audio_id"]: (r["phones"], r["durations"], r["total_frames"]) for r in align.clip_durations(align.intervals(df)).collect()}
    assert got == {k: (["a", 'b"c'], [8, 25], 33) for k in ("w", "p")}


def test_l1_quirks(spark):
    log = "| > loss_mel: 9\n\x1b[1m > GLOBAL_STEP: 5\n| > loss_mel: \x1b[92m21.5\n| > loss_mel: 20.5\n| > avg_loss_mel: 1e-05\n > GLOBAL_STEP: 6 | > loss_mel: 3\n"
    df = spark.createDataFrame([("r", log)], "run string, content string")
    assert rows(trainlog.records(readers.log_lines(df)).select("rec", "step", "name", "value")) == [(1, 5, "avg_loss_mel", 1.0), (1, 5, "loss_mel", 20.5)]


@pytest.mark.parametrize("n", [3, 1000, 1001, 2500])
def test_l4_subsample(spark, n):
    df = spark.createDataFrame([("r", "m", i, float(i)) for i in range(n)], "run string, name string, rec long, value double")
    got = [r["value"] for r in trainlog.subsample(df).orderBy("k").collect()]
    step = (n - 1) / 999
    assert got == ([float(i) for i in range(n)] if n <= 1000 else [float(n - 1 if k == 999 else int(k * step)) for k in range(1000)])


def test_l6_l7(spark):
    df = spark.createDataFrame([("r", "m", float(v)) for v in (1, 2, 4, 9)], "run string, name string, value double")
    r = trainlog.axis_limits(df).first()
    p5, p95 = 1.15, 8.25
    assert r["low"] == 0.0 and abs(r["high"] - (p95 + 0.3 * (p95 - p5))) < 1e-9
    flat = spark.createDataFrame([("few", i, "loss_mel", 1.0) for i in range(5)] + [("flat", i, "loss_mel", 1.0) for i in range(20)] + [("falls", i, "loss_mel", 20.0 - i) for i in range(20)], "run string, rec int, name string, value double")
    assert {r["run"]: r["plateau"] for r in trainlog.plateaus(flat, window=10).collect()} == {"few": False, "flat": True, "falls": False}


def test_l5_widths(spark):
    """Short series have narrower means, up to the widest."""
    r = random.Random(5)
    series = {n: [r.choice([r.random(), None]) for _ in range(n)] for n in (1, 20, 21, 49, 249, 250, 400)}
    df = spark.createDataFrame([(str(n), "m", k, v) for n, vs in series.items() for k, v in enumerate(vs)], "run string, name string, k long, value double")
    want = {}
    for n, vs in series.items():
        w = min(50, n // 5) if n > 20 else 1
        want |= {(str(n), k): sum(v or 0 for v in vs[k - w + 1 : k + 1]) / w for k in range(w - 1, n)}
    assert {(x["run"], x["k"]): x["value"] for x in trainlog.moving_average(df).collect()} == pytest.approx(want)


def test_l5_moving_average_of_a_large_level(spark):
    """Sums of a whole series would lose the small steps of later values."""
    df = spark.createDataFrame([("r", "m", i, 1e15 if i < 50 else float(i % 7)) for i in range(400)], "run string, name string, k long, value double")
    got = {r["k"]: r["value"] for r in trainlog.moving_average(df).collect()}
    assert min(got) == 49
    assert all(got[k] == pytest.approx(sum(float(i % 7) for i in range(k - 49, k + 1)) / 50) for k in range(100, 400))


def test_t3_grid_is_that_of_single_thresholds(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, i, 10 * i, 10 ** (rng.choice((-60, -43, -38, -33, -20)) / 10)) for k in ("a", "b") for i in range(400)], "k string, frame_idx long, t_ms long, mean_sq double")
    length = df.groupBy("k").agg((F.max("t_ms") + 10).alias("duration"))
    want = set()
    for i, (db, least) in enumerate((db, least) for db in segment.THRESHOLDS for least in segment.LEAST_SILENCES):
        want |= {(r["k"], i, r["start"], r["end"]) for r in segment.regions(segment.silences(df, "k", F.lit(db), least), length, "k").collect()}
    assert set(map(tuple, segment.grid_regions(df, "k").select("k", "idx", "start", "end").collect())) == want


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 10_000])
def test_t1_chunks_of_a_recording_give_the_runs_of_the_whole(spark, monkeypatch, chunk):
    """Series with long silences, with none, with single frames, and with frames that are missing."""
    monkeypatch.setattr(segment, "CHUNK", chunk)
    r = random.Random(chunk)
    series = {k: [r.random() < share for _ in range(300)] for k, share in (("a", 0.5), ("b", 0.95), ("c", 0.05), ("d", 1.0), ("e", 0.0))} | {"f": [True], "g": [i // 100 != 1 for i in range(300)], None: [True] * 9}
    frames = [(k, i, 10 * i, 1e-9 if s else 1.0) for k, xs in series.items() for i, s in enumerate(xs) if k != "b" or i % 5]
    r.shuffle(frames)
    want = set()
    for k in series:
        run = []
        for _, i, t, level in [*sorted((f for f in frames if f[0] == k), key=lambda f: f[1]), (k, None, None, 1.0)]:
            if level < 1:
                run.append(t)
            elif run:
                want.add((k, run[0], run[-1] + 10))
                run = []
    df = spark.createDataFrame(frames, "k string, frame_idx long, t_ms long, mean_sq double")
    got = [tuple(x) for x in segment.silences(df, "k", F.lit(-40), 0).select("k", "start", "end").collect()]
    assert len(got) == len(want) and set(got) == want
    longest = segment.silences(df, "k", F.lit(-40), 50).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {x["k"]: x["n"] for x in longest} == {k: n for k in series if (n := sum(w[0] == k and w[2] - w[1] >= 50 for w in want))}


def test_v_encode_decode(spark):
    freq = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 9)], "token string, count long")
    v = vocab.build_vocabulary(freq, spark.createDataFrame([("EN",), ("FR",)], "code string"))
    assert [r["token"] for r in v.filter("id >= 6").orderBy("id").collect()] == ["d", "a", "b", "EN", "FR"]
    texts = spark.createDataFrame([(1, ["a", "d", "zz"]), (2, []), (3, ["b"])], "k int, tokens array<string>")
    coded = vocab.encode(texts, v, "k")
    assert {r["k"]: r["ids"] for r in coded.collect()} == {1: [7, 6, 3], 2: [], 3: [8]}
    assert {r["k"]: r["tokens"] for r in vocab.decode(coded, v, "k").collect()} == {1: ["a", "d", "<unk>"], 2: [], 3: ["b"]}
    twice = spark.createDataFrame([(1, ["a"]), (1, ["b", "d"]), (1, None)], "k int, tokens array<string>")
    assert sorted(r["ids"] for r in vocab.encode(twice, v, "k").collect()) == [[], [7], [8, 6]]
    by_map = texts.select("k", vocab.encode_by_map(F.col("tokens"), {r["token"]: r["id"] for r in v.collect()}).alias("ids"))
    assert {r["k"]: r["ids"] for r in by_map.collect()} == {1: [7, 6, 3], 2: [], 3: [8]}


def test_v_encode_in_batches_is_the_join(spark, monkeypatch):
    """Without a shuffle up to a bound; the same beyond it."""
    r = random.Random(4)
    v = spark.createDataFrame([(i, f"t{i % 40}", "phoneme") for i in range(50)], "id long, token string, kind string")
    texts = spark.createDataFrame([(i % 90, None if i % 17 == 0 else [r.choice([f"t{r.randrange(60)}", "", None]) for _ in range(r.randrange(6))]) for i in range(400)], "k int, tokens array<string>")
    coded = vocab.encode(texts, v, "k")
    assert "Exchange" not in coded._jdf.queryExecution().executedPlan().toString()
    back = vocab.decode(coded, v, "k")
    got = [rows(coded), rows(back)]
    monkeypatch.setattr(vocab, "MOST_HELD", 3)
    assert [rows(vocab.encode(texts, v, "k")), rows(vocab.decode(vocab.encode(texts, v, "k"), v, "k"))] == got
    assert max(i for _, ids in got[0] for i in ids) >= 40  # the later of two ids of a token


def test_j4_zip_drops_what_is_over(spark):
    r = spark.createDataFrame([("k", 10), ("k", 20), ("k", 30)], "k string, start int")
    e = spark.createDataFrame([("k", "x", 2), ("k", "y", None)], "k string, e string, n int")
    assert [(x["start"], x["e"]) for x in manifest.zip_ordinal(r, e, "k", "start", "n").orderBy("start").collect()] == [(10, "y"), (20, "x")]


def test_h_word_list_without_headers_for_ipa(spark):
    html = "<table><tr><td>No.</td><td>Abaza</td><td>Gloss</td></tr><tr><td>1</td><td>kʰiɾ</td><td>writing</td></tr><tr><td>x</td><td>a</td><td>b</td></tr><tr><td></td><td>ɡa</td><td></td></tr></table>"
    merged = "<table><tr><th>Entry</th><th>Ortho</th><th>IPA</th><th>English</th></tr><tr><td>1գիր</td><td>kʰiɾ&nbsp;writing</td></tr><tr><td>2 բ</td><td>paɾ word</td></tr><tr><td>none</td><td>x</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, merged), (3, "<p>no table</p>"), (4, None)], "page_id int, html string")
    got = rows(extract.entries(extract.cells(pages)).select("page_id", "entry_number", "ipa", "english", "orthography"))
    # without a hard space the text is cut at the last space that follows a character beyond ASCII
    assert got == [(1, None, "ɡa", None, None), (1, 1, "kʰiɾ", "writing", None), (2, 1, "kʰiɾ", "writing", "գիր"), (2, 2, "paɾ", "word", "բ")]


def test_h_pages_that_a_parser_gives_up_on(spark):
    table = "<table><tr><td>1</td><td>a</td></tr></table>"
    pages = spark.createDataFrame([(1, table + "<![x]>" + table), (2, "<![foo bar[ x>" + table), (3, "<![CDATA[x]]>" + table), (4, ""), (5, None), (6, "<a href='x'>t</a><![if !IE]><a href='y'>u</a>")], "page_id int, html string")
    n = {r["page_id"]: r["count"] for r in extract.cells(pages).groupBy("page_id").count().collect()}
    assert n == {1: 4, 2: 2, 3: 2}
    assert rows(extract.links(pages)) == [(6, 0, "x", "t"), (6, 1, "y", "u")]
    assert extract.markup_errors(pages).count() == 0


def test_k9_unreadable_files_give_clips_without_samples(spark):
    good = spark.createDataFrame([("a", [0.5] * 800)], "k string, x array<double>").select(F.lit("a").alias("segment_key"), readers.wav(F.col("x"), F.lit(8000)).alias("content"))
    files = good.unionByName(spark.createDataFrame([("b", bytearray(b"no audio")), ("c", None)], "segment_key string, content binary"))
    got = readers.pcm_clips(files.select("segment_key", F.lit(-5).cast("long").alias("start_ms"), F.lit(50).cast("long").alias("end_ms"), "content"))
    assert {r["segment_key"]: r["pcm"] and len(r["pcm"]) for r in got.collect()} == {"a": 800, "b": None, "c": None}


@pytest.mark.parametrize(("href", "want"), [("x.html", "http://a.org/b/c/x.html"), ("../x.html", "http://a.org/b/x.html"), ("../../../x", "http://a.org/x"), ("/x", "http://a.org/x"), ("https://z.org/q", "https://z.org/q"), ("//z.org/q", "http://z.org/q"), ("#t", "http://a.org/b/c/d.html#t"), ("./y", "http://a.org/b/c/y")])
def test_h9_resolve(spark, href, want):
    df = spark.createDataFrame([("http://a.org/b/c/d.html", href)], "p string, h string")
    assert df.select(extract.resolved(F.col("p"), F.col("h"))).first()[0] == want


def test_coarse_categories(spark):
    df = spark.createDataFrame([(t,) for t in ("ˈ", "ː", ".", "̋", "a", "b", "t͡s", "aʰ", "kʰ")], "t string")
    assert [r[0] for r in df.select(ipa.coarse_category(F.col("t"))).collect()] == ["stress", "length", "boundary", "consonant", "vowel", "consonant", "affricate", "vowel", "consonant"]


RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x",
}


def test_h9_examples_of_the_rfc(spark):
    """Those of RFC 3986, 5.4, and others, as the standard library joins them."""
    base = "http://a/b/c/d;p?q"
    others = ["a//b", "http:g", "HTTP:g", "http:?q", "c/../d.html", "../../../..", "x/..", "x/.", "a/b/../../c", "/", "//", "//h/../x", "?", "mailto:a@b", "https://x/../y", "é/ü", "/a/b/../"]
    pages = [base, "http://a", "http://a/", "http://a/b/", "https://h.example.org/x/y.html#top", "http://a/b/c/d?x/y"]
    df = spark.createDataFrame([(p, h) for p in pages for h in [*RFC, *others]], "p string, h string")
    got = {(r["p"], r["h"]): r["t"] for r in df.select("p", "h", extract.resolved(F.col("p"), F.col("h")).alias("t")).collect()}
    assert {h: got[base, h] for h in RFC} == RFC
    odd = {"?", "//", "", "http:?q"}  # the library drops an empty query, keeps no empty authority and gives an empty link the page as it is
    assert {k: v for k, v in got.items() if k[1] not in odd} == {(p, h): urljoin(p, h) for p, h in got if h not in odd}
    assert spark.createDataFrame([(None, "x"), ("http://a/", None)], "p string, h string").filter(extract.resolved(F.col("p"), F.col("h")).isNotNull()).count() == 0


def test_s3_fields_of_a_million_characters(spark, tmp_path):
    texts = ["x" * 1_000_000, "\\" * 1_000_000, "|" * 1_000_000, '\\|"\n' * 250_000, "a\\nb"]
    df = spark.createDataFrame([(str(i), t, "s") for i, t in enumerate(texts)], "audio_file string, text string, speaker_name string")
    columns = ["audio_file", "text", "speaker_name"]
    sinks.write_pipe_manifest(df, str(tmp_path / "m"), columns)
    back = readers.pipe_manifest(spark, str(tmp_path / "m/*"), columns)
    assert {r["audio_file"]: r["text"] for r in back.collect()} == dict(zip("01234", texts, strict=True))


def test_d3_one_file_of_an_id_counts(spark):
    grid = 'item []:\n    item [1]:\n        name = "words"\n            xmin = 0\n            xmax = 0.1\n            text = "{}" \n            xmin = 0.1\n            xmax = 0.2\n            text = "{}" \n'
    rows = [("x", "a/x.TextGrid", grid.format("p", "q")), ("x", "b/x.TextGrid", grid.format("r", "s")), ("y", "a/y.TextGrid", grid.format("t", "u")), ("z", "a/z.TextGrid", "")]
    files = spark.createDataFrame(rows, "audio_id string, path string, content string")
    clips = align.clip_durations(align.intervals(align.one_file_each(files)))
    assert {r["audio_id"]: r["phones"] for r in clips.collect()} == {"x": ["r", "s"], "y": ["t", "u"]}
    assert tuple(align.duration_counts(files, clips).first()) == (4, 2, 1)
    m = spark.createDataFrame([("train", "x", ["r", "s"])], "split string, audio_id string, tokens array<string>")
    assert align.duration_job(m, files)[1].first().asDict() == {"split": "train", "total": 1, "updated": 1, "matched": 1, "mismatched": 0}


def test_d6_masks_and_the_corpus(spark):
    rows = [([1.0, 2.0, 4.0], [2.0, 2.0, 1.0], [1.0, 1.0, 0.0]), ([8.0], [1.0, 5.0], [1.0, 1.0]), ([], [], []), ([1.0, 3.0], [3.0, 1.0], [0.0, None])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, m array<double>")
    sq = lambda x, y: (np.log(x + 1e-6) - np.log(y + 1e-6)) ** 2
    got = [r[0] for r in df.select(align.log_agreement(F.col("a"), F.col("b"), 2.0, F.col("m"))).collect()]
    assert got == pytest.approx([2 * sq(1, 2) / 2.000001, 2 * sq(8, 1) / 1.000001, 0, 0])
    r = align.corpus_agreement(df, "a", "b", "m").first()
    assert (r["clips"], r["loss"]) == (4, pytest.approx((sq(1, 2) + sq(8, 1)) / 3.000001))
    assert align.corpus_agreement(df, "a", "b").first()["loss"] == pytest.approx((sq(1, 2) + sq(4, 1) + sq(8, 1) + 2 * sq(1, 3)) / 6.000001)
    assert align.corpus_agreement(df.limit(0), "a", "b", "m").first()["loss"] == 0


def test_k8_titles(spark):
    df = spark.createDataFrame([("syllable/word",), ("secondary articulation",), ("tap/flap",)], "x string")
    assert [r[0] for r in df.select(stats.titled(F.col("x"))).collect()] == ["Syllable/Word", "Secondary Articulation", "Tap/Flap"]


def test_j4_ties_do_not_depend_on_arrival(spark):
    r = [("k", 10, i) for i in range(30)]
    e = [("k", f"x{i}", None) for i in range(30)]
    one = manifest.zip_ordinal(spark.createDataFrame(r, "k string, start int, z int"), spark.createDataFrame(e, "k string, e string, n int"), "k", "start", "n")
    two = manifest.zip_ordinal(spark.createDataFrame(r[::-1], "k string, start int, z int").repartition(3), spark.createDataFrame(e[::-1], "k string, e string, n int"), "k", "start", "n")
    assert rows(one.select("z", "e")) == rows(two.select("z", "e"))


def test_s8_blocks_of_a_long_file(spark, monkeypatch):
    w = spark.createDataFrame([("a", [((i * 37) % 200) / 200 - 0.5 for i in range(1235)])], "rec_id string, x array<double>").select("rec_id", readers.wav(F.col("x"), F.lit(1000)).alias("content"))
    whole = rows(readers.pcm_frames(w))
    monkeypatch.setattr(readers, "FRAMES_AT_ONCE", 7)
    assert rows(readers.pcm_frames(w)) == whole and len(whole) == 124


def jobs(spark, work):
    """How many Spark jobs some work takes."""
    sc = spark.sparkContext
    group = f"counted-{random.random()}"
    sc.setJobGroup(group, "")
    work()
    found = sc.statusTracker().getJobIdsForGroup(group)
    sc.setJobGroup("none", "")
    return len(found)


def test_s2_rows_and_counts_by_one_job(spark, tmp_path):
    rows = [(i, ["train", "dev", "test", None][i % 4], "" if i % 5 == 0 else "a", "200" if i % 3 == 0 else "700") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, split string, ipa_audio_universal string, duration_ms string")
    usable, counts = filters.load_corpus(df, ["train", "dev"])
    want = counts.first()
    got = []
    assert jobs(spark, lambda: got.append(filters.write_corpus(df, ["train", "dev"], str(tmp_path / "x")))) == 1
    assert got[0].first() == want and spark.read.parquet(str(tmp_path / "x")).count() == usable.count() == want["in_duration"]
    assert filters.write_corpus(df.limit(0), None, str(tmp_path / "y")).first()["loaded"] == 0


def test_g7_sketches_of_batches(spark):
    """The union of five batches is within 2 % of the exact number, and is that of all at once."""
    r = random.Random(6)
    letters = [chr(c) + mark for c in range(0x4E00, 0x4E00 + 9000) for mark in ("", "\u0301")]
    batches = [(b, lang, " ".join(r.choices(letters, k=3000))) for b in range(5) for lang, n in (("EN", 6), ("FR", 1)) for _ in range(n)] + [(0, "NO", None), (0, "NO", "")]
    df = spark.createDataFrame(batches, "batch int, language_code string, ipa string")
    exact = {x["language_code"]: (x["tokens"], x["unique_tokens"]) for x in stats.language_tokens(df).groupBy("language_code").agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("unique_tokens")).collect()}
    one = {x["language_code"]: x for x in stats.merged_sketches(stats.language_sketches(df, "batch"), "language_code").collect()}
    two = {x["language_code"]: x for x in stats.merged_sketches(stats.language_sketches(df), "language_code").collect()}
    for lang, (tokens, unique) in exact.items():
        assert one[lang]["tokens"] == tokens and abs(one[lang]["unique_tokens"] - unique) <= 0.02 * unique
        assert one[lang]["unique_tokens"] == pytest.approx(two[lang]["unique_tokens"], rel=0.01)
    assert (one["NO"]["entries"], one["NO"]["tokens"], one["NO"]["unique_tokens"]) == (2, 0, 0)


def test_pages_reach_python_in_pieces(spark):
    """A batch of rows has a bounded size whatever pages weigh; keys may be repeated, characters beyond 16 bits stay whole."""
    table = lambda text, n: "<table><tr><td>1</td><td>" + text * n + "</td></tr></table>"
    df = spark.createDataFrame([(1, table("\U0001d11e x\n", 3000)), (1, table("a", 10)), (2, None), (3, ""), (4, "<a href='u'>" + "y " * 4000 + "</a>")], "page_id long, html string").coalesce(1)
    sizes = extract._pieces(df, "page_id", "html").select(F.max(F.length("_piece")).alias("most"), F.count(F.lit(1)).alias("n")).first()
    assert sizes["most"] == extract.PIECE and sizes["n"] > 15
    got = [(r["page_id"], r["col_idx"], r["text"]) for r in extract.cells(df).collect()]
    assert got == [(1, 0, "1"), (1, 1, ("\U0001d11e x\n" * 3000).strip()), (1, 0, "1"), (1, 1, "a" * 10)]
    assert [r["text"] for r in extract.links(df).collect()] == [("y " * 4000).strip()]


def test_small_files_are_packed(spark):
    """Their number doesn't follow that of the names; a separator in a content is refused."""
    want = [(f"n{i}", f"line {i}\n\x02\r\n" * (i % 3)) for i in range(3000)]
    path = sinks.scratch(spark)
    sinks.write_packs(spark.createDataFrame(want, "name string, content string"), path, "name", "content")
    assert readers.listing(spark, path, "*.txt").count() == 1
    assert sorted(map(tuple, readers.packed(spark, path).collect())) == sorted(want)
    with pytest.raises(Exception, match="separator"):
        sinks.write_packs(spark.createDataFrame([("a", "x\x03y")], "name string, content string"), sinks.scratch(spark), "name", "content")
