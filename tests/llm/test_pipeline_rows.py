import random

import corpus_pipeline
import pytest

DOCS = "doc_id long, text string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(3, 8))) for _ in range(n))


def staged(spark, tmp_path, stage, rows, stored=True):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], DOCS).repartition(4)
    if stored:
        docs.write.parquet(f"{tmp_path}/in")
        docs = spark.read.parquet(f"{tmp_path}/in")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


@pytest.mark.parametrize("stored", [True, False])
def test_exact_dedup_keeps_one_row_of_repeated_and_null_ids(spark, tmp_path, stored):
    rows = [(None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "c"), (None, "c"), (4, "d"), (4, "e"), (5, "e"), (6, None), (6, None), (None, "")]
    got = staged(spark, tmp_path, corpus_pipeline.keep_distinct, rows, stored)
    assert got == sorted([(3, "a"), (None, "b"), (None, "c"), (4, "d"), (5, "e"), (6, None)], key=str)


def test_near_dedup_drops_rows_and_not_ids(spark, tmp_path):
    rng = random.Random(4)
    base, shared, nameless, clean, other = (prose(rng, 400) for _ in range(5))
    near = lambda t: t + " end"
    rows = [(1, base), (None, near(base)), (None, clean), (7, near(near(base))), (7, other), (8, shared), (8, near(shared)), (None, nameless), (None, near(nameless))]
    got = staged(spark, tmp_path, corpus_pipeline.keep_one_of_near, rows)
    assert len(got) == 5
    assert {(1, base), (None, clean), (7, other)} <= set(got)
    assert sum(i == 8 for i, _ in got) == 1
    assert sum(i is None for i, _ in got) == 2


def test_columns_of_any_name_go_through(spark, tmp_path):
    """Names that stages use inside, and a struct column, keep their values."""
    rng = random.Random(8)
    passage, texts = prose(rng, 90), [prose(rng, 300) for _ in range(4)]
    texts = [texts[0], texts[0], texts[1] + passage, passage + texts[2], texts[3], texts[3] + " end", None]
    names = ["kept", "kept_text", "n_bytes", "n_removed", "n_spans", "_id", "_sha", "_row", "row", "doc", "of", "root", "id", "body", "file", "path", "at", "stays", "uid", "a b.c"]
    schema = DOCS + ", " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(i, t, len(t or ""), *(f"{n} {i}" for n in names)) for i, t in enumerate(texts)], schema)
    docs.write.parquet(f"{tmp_path}/in")
    docs, left = spark.read.parquet(f"{tmp_path}/in"), []
    for k, stage in enumerate((corpus_pipeline.keep_distinct, corpus_pipeline.keep_one_of_near, corpus_pipeline.cut_repeats)):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert all(r[n] == f"{n} {r['doc_id']}" for r in docs.collect() for n in names)
    assert [sorted(x) for x in left] == [[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 6], [1, 2, 3, 4, 6]]
    assert passage not in left[2][2] + left[2][3] and left[2][6] is None


def test_repeated_rows_pass_the_dedup_stages_once(spark, tmp_path):
    rng = random.Random(6)
    text = prose(rng, 300)
    (tmp_path / "a").mkdir()
    once = staged(spark, tmp_path / "a", corpus_pipeline.keep_distinct, [(3, text), (3, text), (None, text + " x"), (None, text + " x")])
    assert once == sorted([(3, text), (None, text + " x")], key=str)
