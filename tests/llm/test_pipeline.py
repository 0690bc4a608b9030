import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import SF

#: It takes some bad labels to learn from.
LARGER = "/root/testdata/sf0.01"


def test_stages_do_their_work(spark, tmp_path):
    rng = random.Random(0)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    passage = prose(80)
    base = prose(900)
    near = base.split()
    near[450] = "changed"
    texts = {
        1: base, 2: " ".join(near), 3: prose(300), 4: prose(300) + " " + passage, 5: passage + " " + prose(200), 6: prose(10), 7: " ".join(f"{w}###" for w in prose(200).split()), 8: None, 9: "",
    }
    texts[10] = texts[3]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    planted = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], schema)
    top = str(tmp_path)
    planted.unionByName(docs.select(planted.columns)).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{LARGER}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000).write.parquet(f"{top}/labels.parquet")
    frame, seen = spark.read.parquet(f"{top}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, top)
        frame.write.parquet(f"{top}/{i}")
        frame = spark.read.parquet(f"{top}/{i}")
        seen.append({r["doc_id"]: r for r in frame.filter("doc_id <= 10").collect()})
    rules, exact, near_, cut, packed = seen
    assert set(rules) == {1, 2, 3, 4, 5, 10}
    assert set(exact) == {1, 2, 4, 5, 10}
    assert set(near_) == {1, 4, 5, 10}
    assert cut[10]["text"] == texts[3] and cut[1]["text"] == base
    assert passage not in cut[4]["text"] and passage not in cut[5]["text"]
    assert len(cut[4]["text"]) == len(texts[4]) - len(passage) - 1 or len(cut[4]["text"]) == len(texts[4]) - len(passage)
    assert cut[4]["n_chars"] == len(cut[4]["text"])
    assert set(packed) == {1, 4, 5, 10}


def test_an_empty_table_goes_through(spark, tmp_path):
    top = str(tmp_path)
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{top}/labels.parquet")
    assert corpus_pipeline.run(spark, top).count() == 0
