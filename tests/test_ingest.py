import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from phonoframe.operators import catalog
from phonoframe.streaming import ingest

SITE = "http://a.example.org"
SCHEMA = "url string, html string"


def language_page(code, *names):
    cells = "".join(f'<tr><td><a href="../sound/{n}.wav">w</a></td><td><a href="/w/{n}.html">l</a></td><td>1 – 9</td><td>n</td></tr>' for n in names)
    return (f"{SITE}/Language/{code}/i.html", f"<table><tr><th>WAV audio</th><th>Word list</th><th>Entries</th><th>Notes</th></tr>{cells}</table>")


def word_list(name, *words):
    cells = "".join(f"<tr><td>{i}</td><td>{w}</td><td>gloss {w}</td></tr>" for i, w in enumerate(words, 1))
    return (f"{SITE}/w/{name}.html", f"<table><tr><th>Entry</th><th>Transcription</th><th>English</th></tr>{cells}</table>")


def index(*codes):
    return (f"{SITE}/all.html", "".join(f'<a href="../Language/{c}/i.html">Name {c}</a>' for c in codes))


A, B, C = (f"{c}_word-list_2009_01" for c in ("aa", "bb", "cc"))


def state(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in ingest.KEYS if store.read(t) is not None}


@pytest.fixture
def site(spark, tmp_path):
    def add(*pages):
        spark.createDataFrame(list(pages), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/catalog", files_per_batch=1)

    add.top = tmp_path
    return add


def test_pages_come_in_any_order_and_again(spark, site):
    site(word_list(A, "ka", "ta"), word_list(B, "pa"))
    store = site(language_page("AA", A), index("AA", "BB"))
    e = ingest.exported(store)
    assert sorted((r["language_name"], r["audio_filename"], r["ipa"]) for r in e.collect()) == [("Name AA", A, "ka"), ("Name AA", A, "ta")]
    ids = {r["audio_filename"]: r["recording_id"] for r in store.read("recordings").collect()}
    store = site(language_page("BB", B, C), language_page("AA", A), word_list(A, "new"), word_list(B))
    again = {r["audio_filename"]: r["recording_id"] for r in store.read("recordings").collect()}
    assert again[A] == ids[A] and sorted(again.values()) == [1, 2, 3]
    e = ingest.exported(store)
    assert sorted((r["language_code"], r["ipa"]) for r in e.collect()) == [("AA", "new"), ("BB", "pa")]  # B's page without rows leaves what was there


def test_a_batch_that_runs_again_changes_nothing(spark, site):
    store = site(word_list(A, "ka"), language_page("AA", A), index("AA"), (None, "x"), (f"{SITE}/odd.html", None))
    before = state(store)
    assert set(before) == set(ingest.KEYS)
    (site.top / "catalog/stream").rename(site.top / "lost")  # the stream's checkpoint is lost
    after = state(site(word_list(B, "pa")))
    assert set(before["entries"]) < set(after["entries"]) and len(after["entries"]) == 2
    assert before["recordings"] == after["recordings"] and before["languages"] == after["languages"]


def files(top, table):
    """The table's files: name -> bytes."""
    return {str(f): f.stat().st_size for f in (top / table).rglob("*.parquet")}


def entries_of(spark, n, per_page, version="a", first=0):
    return spark.range(first * per_page, first * per_page + n).select(F.concat(F.lit("http://a.example.org/w/"), F.floor(F.col("id") / per_page), F.lit(".html")).alias("wordlist_url"), (F.col("id") % per_page).cast("int").alias("entry_number"), F.sha2(F.concat("id", F.lit(version)), 256).alias("ipa"))


def replaced(old, new):
    return new if old is None else catalog.replace_of(old, new, "wordlist_url")


def test_a_hundred_pages_rewrite_little_of_a_million_rows(spark, tmp_path):
    store = ingest.Catalog(spark, str(tmp_path))
    store.merge("entries", entries_of(spark, 1_000_000, 25), replaced)
    before = files(tmp_path, "entries")
    assert store.buckets("entries") == ingest.buckets_for(1_000_000) == 4096
    pages = [f"http://a.example.org/w/{i * 397}.html" for i in range(100)]
    new = entries_of(spark, 1_000_000, 25, "b").filter(F.col("wordlist_url").isin(pages))
    store.merge("entries", new, replaced)
    after = files(tmp_path, "entries")
    written = sum(size for f, size in after.items() if f not in before)
    assert 0 < written < 0.03 * sum(before.values())  # and once more as much, which goes, aside
    assert not (tmp_path / "entries/aside").exists()
    rows = store.read("entries")
    assert rows.count() == 1_000_000
    assert rows.exceptAll(entries_of(spark, 1_000_000, 25)).count() == new.count() == rows.join(new, rows.columns, "left_semi").count() == 2500


def test_buckets_grow_with_the_table(spark, tmp_path):
    store, n = ingest.Catalog(spark, str(tmp_path)), 0
    seen = []
    for size in (100, 4000, 20_000):
        store.merge("entries", entries_of(spark, size, 5, first=n // 5), replaced)
        n += size
        seen.append(store.buckets("entries"))
        assert store.read("entries").count() == n
        assert len([f for f in (tmp_path / "entries").iterdir() if f.name.startswith("buckets=")]) == 1
    assert seen == sorted(seen) and seen[0] == ingest.LEAST_BUCKETS < seen[-1]


def test_pages_without_news_touch_nothing(spark, site):
    pages = word_list(A, "ka", "ta"), word_list(B, "pa"), language_page("AA", A), index("AA", "BB"), (f"{SITE}/odd.html", None)
    site(*pages)
    before = {t: files(site.top / "catalog", t) for t in ingest.KEYS}
    store = site(*pages)
    assert {t: files(site.top / "catalog", t) for t in ingest.KEYS} == before
    site(word_list(A, "new"))
    assert sorted(r["ipa"] for r in site(*pages).read("entries").collect()) == ["ka", "pa", "ta"]  # an older page that comes back is news
    assert store.read("pages").count() == 5


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_merge_that_is_cut_off_is_taken_up(spark, tmp_path, monkeypatch, when):
    """The run ends while the new rows are written aside, or when they are there and the old ones are still in place."""
    store = ingest.Catalog(spark, str(tmp_path))
    store.merge("entries", entries_of(spark, 1000, 5), replaced)
    new = entries_of(spark, 100, 5, "b")

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest.Catalog, "_put", fails)
    with pytest.raises(RuntimeError, match="lost"):
        store.merge("entries", new, replaced)
    monkeypatch.undo()
    if when == "before":
        (tmp_path / "entries/aside/_SUCCESS").unlink()
    store = ingest.Catalog(spark, str(tmp_path))
    assert store.read("entries").count() == 1000  # one that reads leaves all as it is
    assert (tmp_path / "entries/aside").exists()
    store.take_up("entries")
    rows = store.read("entries")
    assert rows.count() == 1000 and rows.join(new, rows.columns, "left_semi").count() == (100 if when == "after" else 0)
    assert not (tmp_path / "entries/aside").exists()


def test_pages_and_entries_are_not_left_in_the_shared_folder(spark, site):
    """What a run stores on its way goes when what comes of it is written; a few small tables stay."""
    size = lambda top: sum(f.stat().st_size for f in Path(top).rglob("*.parquet"))
    words = [hashlib.sha256(b"%d" % i).hexdigest() for i in range(8000)]
    shared = spark.conf.get("spark.checkpoint.dir")
    before = size(shared)
    site(word_list(A, *words[:4000]), word_list(B, *words[4000:]), language_page("AA", A), index("AA"))
    store = site(word_list(A, *words[:3000]))
    assert store.read("entries").count() == 7000
    assert size(shared) - before < 0.2 * size(site.top / "in")
