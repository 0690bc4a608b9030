"""From raw documents to packed sequences in five stages, each an operator of phonoframe.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm import exact_dedup, near, packing, quality, repeats
from phonoframe.llm.common import columns_of, cut, new_table, remove_table, settings, small, whole, with_rows

#: Near duplicates: shingles of so many words, a Jaccard similarity of so much at least.
WORDS, SIMILARITY = 5, 0.8


#: Python gets few rows at once while stages are written, so that executors hold few whole texts outside Spark's heap.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of ``docs`` (row, doc) less those whose row is in ``dropped``."""
    return docs.join(small(cut(dropped.select("row").distinct())), "row", "left_anti").select("doc.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the rules learned from labels; a null text fails.

    Each row is judged by its text alone: repeated rows, rows with one doc_id or none stay or go as their texts do. Without labels the base rules decide.
    """
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, rules).filter("_quality.kept").drop("_quality")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the largest doc_id (null is the smallest), of rows equal in both the first one.

    A null text counts as empty.
    """
    docs = with_rows(docs)
    texts = docs.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    rows = cut(texts.select("row", F.col("doc_id").alias("of"), F.unhex(F.sha2(whole(), 256)).alias("digest")))
    lesser = exact_dedup.exact_dedup(texts).filter("not kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).distinct()
    again = rows.groupBy("of", "digest").agg(F.min("row").alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("of").alias("id"), F.col("digest").alias("sha"), "stays")
    same = F.col("of").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha"))
    dropped = rows.join(small(cut(lesser)), same, "left_semi").select("row").unionByName(rows.join(small(cut(again)), same).filter("row != stays").select("row"))
    return without(docs, dropped)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of SIMILARITY connect one row: that with the least doc_id (null is the largest), then the first.

    Texts without a word, null ones too, are equal.
    """
    docs = with_rows(docs)
    groups = small(cut(near.near_groups(docs.select("row", F.col("doc.text").alias("text")), "row", words=WORDS, similarity=SIMILARITY)))
    named = cut(docs.select("row", F.col("doc.doc_id").alias("of")).join(groups, "row"))
    stays = named.groupBy("root").agg(F.min(F.struct(F.col("of").isNull(), "of", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return without(docs, named.join(stays, "row", "left_anti"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less every byte of the 200-byte strings that occur elsewhere; characters cut in two go.

    A null text stays null. Rows equal in key and text lose their whole text if it has 200 bytes.
    """
    rest = F.struct(*(columns_of(docs, "doc_id", "text") or [F.lit(0).alias("_")])).alias("rest")
    done = repeats.remove_repeats(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), rest), "id", "body", as_text=True)
    less = F.col("n_removed") > 0
    new = {"doc_id": F.col("id"), "text": F.when(less, F.col("kept")).otherwise(F.col("body"))}
    if "n_chars" in docs.columns:
        old = F.col("rest").getField("n_chars")
        new["n_chars"] = F.when(less, F.length("kept")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    A null text counts as empty and gives one piece with the end's id alone; rows that repeat a doc_id, null too, give pieces each. Other columns go.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", keep_distinct),
    ("SimHash near-dedup", keep_one_of_near),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]
#: SQL has no SimHash and no byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next, and goes when that has been written."""
    docs, places = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            places.append(new_table(spark))
            with settings(spark, SMALL_BATCHES):
                docs.write.parquet(places[-1])
            docs = spark.read.parquet(places[-1])
            if i:
                remove_table(spark, places[-2])
    return docs
