import os

import duckdb
import pytest

from phonoframe.plans import registry

from .conftest import SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["h2_cells", "h5_wordlist_table", "h6_column_roles", "h7_merged_rows", "h8_entries", "i1_ingest"])
def test_documents_with_gaps_repeated_keys_and_no_text_match_sql(spark, tmp_path, name):
    """Pages lack numbers, at their begin too, and have some twice; texts are empty, but for merged rows."""
    ids = [*range(2, 24), 26, 27, 30, 30, 49, *range(50, 75, 7), 64, 64, *range(87, 100), 90, *range(120, 140)]
    texts = [("", f"t <{i}> & ê")[i % 5 > 0 or i // 25 % 4 == 2] + "é" * (k % 2) for k, i in enumerate(ids)]
    spark.createDataFrame(list(zip(ids, texts, [f"s{i % 3}" for i in ids], strict=True)), "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = registry.queries()[name](spark, str(tmp_path)), c.sql(registry.oracle_sql()[name])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)
