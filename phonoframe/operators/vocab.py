"""Vocabularies, speaker maps, encoding and decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import sinks

#: The special tokens with ids 0 to 5.
SPECIALS = ["<pad>", "<sos>", "<eos>", "<unk>", "<blank>", "<sil>"]
UNKNOWN_ID = SPECIALS.index("<unk>")
#: Larger vocabularies are joined, not looked up in a literal map, and not held by tasks.
MAP_TOKENS, MOST_HELD = 200, 100_000


def token_frequency(tokens: DataFrame) -> DataFrame:
    """(token, count) of an exploded (token) table."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def build_vocabulary(frequency: DataFrame, codes: DataFrame, min_count: int = 2) -> DataFrame:
    """(id, token, kind): specials, phonemes by falling count then token, sorted language codes.

    ``frequency`` is (token, count) and ``codes`` (code); both are aggregates, so the rankings are small. What is kept of the first is stored, as it is read twice.
    """
    spark = frequency.sparkSession
    specials = spark.createDataFrame([(i, t, "special") for i, t in enumerate(SPECIALS)], "id long, token string, kind string")
    kept = sinks.stored(frequency.filter(F.col("count") >= min_count))
    phonemes = kept.select((F.row_number().over(W.Window.orderBy(F.desc("count"), "token")) + len(SPECIALS) - 1).cast("long").alias("id"), "token", F.lit("phoneme").alias("kind"))
    n = phonemes.agg(F.count(F.lit(1)).alias("n"))
    langs = codes.select(F.col("code").alias("token")).distinct()
    langs = langs.crossJoin(F.broadcast(n)).select((F.row_number().over(W.Window.orderBy("token")) + F.col("n") + len(SPECIALS) - 1).cast("long").alias("id"), "token", F.lit("language").alias("kind"))
    return specials.unionByName(phonemes).unionByName(langs)


def vocabulary_statistics(frequency: DataFrame, codes: DataFrame, min_count: int = 2) -> DataFrame:
    """One row: total, unique, kept, dropped, languages, size."""
    one = frequency.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("unique_tokens"), F.count_if(F.col("count") >= min_count).alias("kept"), F.count_if(F.col("count") < min_count).alias("dropped"))
    langs = codes.agg(F.countDistinct("code").alias("languages"))
    return one.crossJoin(langs).withColumn("size", F.col("kept") + F.col("languages") + len(SPECIALS))


def token_ids(vocabulary: DataFrame) -> DataFrame:
    """(token, id); a token that is in two sections has the later id."""
    return vocabulary.groupBy("token").agg(F.max("id").alias("id"))


def encode(rows: DataFrame, vocabulary: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, ids array): each row's tokens as ids in order; others get the id of <unk>. Rows that repeat a key stay apart; a null array gives an empty one."""
    return _looked_up(rows, token_ids(vocabulary), key, tokens, "token", "id", UNKNOWN_ID, "ids")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, items: str, item: str, value: str, otherwise: object, name: str) -> DataFrame:
    """(key, ``name``): what ``table`` (item, value) has for each item of the rows' arrays, in order; null arrays give empty ones.

    A table of up to MOST_HELD rows is held by each task, and whole batches are looked up in their row, without a shuffle; larger ones are joined.
    """
    held = table.select(item, value).limit(MOST_HELD + 1).collect()
    if len(held) <= MOST_HELD:
        return rows.select(key, _in_batches(rows, held, table.schema[item].dataType, table.schema[value].dataType, otherwise)(F.col(items)).alias(name))
    numbered = rows.select(key, F.monotonically_increasing_id().alias("_row"), F.col(items).alias("_items"))
    each = numbered.select(key, "_row", F.posexplode_outer("_items").alias("_pos", item))
    found = each.join(table, item, "left")
    at = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce(value, F.lit(otherwise)).alias("_v")))
    listed = found.groupBy(key, "_row").agg(F.array_sort(F.collect_list(at)).alias("_x"))
    return listed.select(key, F.transform("_x", lambda p: p["_v"]).alias(name))


def _in_batches(rows: DataFrame, held: list, item: T.DataType, value: T.DataType, otherwise: object) -> Callable[[Column], Column]:
    """A Spark function of arrays of items that gives arrays of values: the items of a batch are searched in one go."""
    items, values = to_arrow_type(item), to_arrow_type(value)
    shared = rows.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in held if r[0] is not None))

    @F.arrow_udf(T.ArrayType(value))
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array([k for k, _ in shared.value], items)
        made = pa.array([*(v for _, v in shared.value), otherwise], values)  # the last is for what isn't known
        for lists in parts:
            flat = lists.flatten()  # without what is under a null
            at = pc.fill_null(pc.index_in(flat.cast(items), known), len(known))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), made.take(at))

    return of


def encode_by_map(tokens: Column, ids: dict[str, int]) -> Column:
    """As encode for vocabularies of up to MAP_TOKENS tokens, within the row: a map is searched from its start."""
    if len(ids) > MAP_TOKENS:
        raise ValueError("join larger vocabularies")
    literal = F.create_map(*[F.lit(x) for pair in sorted(ids.items()) for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(literal, t), F.lit(ids.get("<unk>", UNKNOWN_ID))))


def decode(rows: DataFrame, vocabulary: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, tokens array): the reverse; unknown ids give <unk>."""
    return _looked_up(rows, vocabulary.select("id", "token"), key, ids, "id", "token", "<unk>", "tokens")


def speaker_map(codes: DataFrame, code: str = "code") -> DataFrame:
    """(speaker, speaker_id): distinct upper-case codes in order, from 0."""
    distinct = codes.select(F.upper(code).alias("speaker")).distinct()
    return distinct.select("speaker", (F.row_number().over(W.Window.orderBy("speaker")) - 1).cast("long").alias("speaker_id"))


def character_set(vocabulary: DataFrame) -> DataFrame:
    """One row: the characters of all phoneme tokens by code point, and how many."""
    letters = vocabulary.filter("kind = 'phoneme'").select(F.explode(F.split("token", "")).alias("c")).filter("c != ''").distinct()
    listed = letters.agg(F.array_sort(F.collect_list(F.struct(F.ascii("c").alias("p"), "c"))).alias("x"))
    return listed.select(F.array_join(F.transform("x", lambda s: s["c"]), "").alias("characters"), F.size("x").cast("long").alias("size"))
