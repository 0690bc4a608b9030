"""Places of rows in an order, and values at places, without a task that orders all of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources import sinks

#: Tables of up to so many rows may be broadcast; they are counted first.
MOST_BROADCAST = 100_000
#: Rows of a part, about; smaller tables make parts of FEW_ROWS, up to Spark's number of shuffle partitions.
PART_ROWS, FEW_ROWS = 1 << 20, 4096
#: Distinct values of a group that one task may order, parts that a longer range of values is counted by, and values sampled for each cut.
SORTED, FINER, OVERSAMPLE = 10_000, 64, 8


def small(df: DataFrame) -> DataFrame:
    """To be broadcast if it has MOST_BROADCAST rows at most."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_g{i}"]) for i, c in enumerate(columns)), F.lit(True))


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(columns)})


def _joined(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Join by columns that may be null; ``right`` is broadcast if it is small."""
    right = small(_renamed(right, columns))
    return left.join(right, _same(left, right, columns)).drop(*[f"_g{i}" for i in range(len(columns))])


def part_count(n: int, most_of_few: int) -> int:
    """Parts for ``n`` rows: their number follows it."""
    return max(1, -(-n // PART_ROWS), min(most_of_few, -(-n // FEW_ROWS)))


def parted(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """``rows`` stored in ranges of group and order, with _part and _at, which ascends in that order inside a part.

    Spark samples the ranges. Rows that are equal in group and order are told apart by where they come from, so that ranges cut through them too.
    """
    spark = rows.sparkSession
    count = part_count(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*[F.asc_nulls_first(c) for c in [*group, *order]], F.asc("_from")]
    ranged = rows.withColumn("_from", F.monotonically_increasing_id()).repartitionByRange(count, *keys).sortWithinPartitions(*keys).drop("_from")
    return sinks.stored(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def places(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, the place from 1 in its group in order of columns (nulls first), and _size, the group's rows.

    All groups are cut to ranges of about PART_ROWS rows by one shuffle, ties too; counts of the ranges give where each begins, and the order
    inside is that in which Spark sorted it. Rows equal in group and order get different places, in no stated order. Without ``group`` all rows are one.
    """
    n = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n")).head()[0] or 0
    placed = parted(rows, group, order, n)
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    w = W.Window.partitionBy(*group)
    counts = counts.select(*group, "_part", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_before"), F.sum("_n").over(w).alias("_size"))
    done = _joined(placed, sinks.stored(counts), [*group, "_part"])
    return done.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def values_at(counted: DataFrame, group: list[str], value: str, sought: DataFrame) -> DataFrame:
    """``sought`` (``group``, _name, _place from 1) with _value, that at the place in the ascending order of each group.

    ``counted`` is a stored (``group``, value, n): each value once with how often it occurs. Ranges of values with more than SORTED of them
    are counted by FINER parts, and only the part that holds a place is looked at further, so that no task orders more than that.
    """
    v = F.col(value)
    kind = counted.schema[value].dataType
    now = sought.withColumns({"_low": F.lit(None).cast(kind), "_high": F.lit(None).cast(kind), "_before": F.lit(0).cast("long")})
    bounds = ["_low", "_high", "_before"]
    level = 0
    while True:
        now = sinks.stored(now)
        ranges = now.select(*group, *bounds).distinct()
        inside = _joined(counted, ranges, group).filter((F.col("_low").isNull() | (v > F.col("_low"))) & (F.col("_high").isNull() | (v <= F.col("_high"))))
        key = [*group, *bounds]
        sizes = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("_distinct"))
        large = sinks.stored(sizes.filter(F.col("_distinct") > SORTED))
        if not large.head(1):
            break
        within = _joined(inside, large, key)
        share = F.lit(float(FINER * OVERSAMPLE)) / F.col("_distinct")
        drawn = within.filter(F.pmod(F.xxhash64(value, F.lit(level)), F.lit(1 << 30)) < share * (1 << 30))
        listed = drawn.groupBy(*key).agg(F.sort_array(F.collect_list(v)).alias("_all"))
        step = F.greatest(F.lit(1), F.ceil(F.size("_all") / FINER)).cast("int")
        edges = sinks.stored(listed.select(*key, F.filter("_all", lambda x, i: (i + 1) % step == 0).alias("_edges")))
        within = _joined(within, edges, key).withColumn("_part", F.size(F.filter("_edges", lambda e: e < v)))
        counts = within.groupBy(*key, "_edges", "_part").agg(F.sum("n").alias("_n"))
        until = F.sum("_n").over(W.Window.partitionBy(*key).orderBy("_part"))
        found = counts.select(*key, (F.col("_before") + until).alias("_until"), (F.col("_before") + until - F.col("_n")).alias("_start"), F.coalesce(F.get("_edges", F.col("_part") - 1), "_low").alias("_l"), F.coalesce(F.get("_edges", F.col("_part")), "_high").alias("_h"))
        finer = _joined(now, sinks.stored(found), key).filter((F.col("_place") > F.col("_start")) & (F.col("_place") <= F.col("_until")))
        finer = finer.select(*group, "_name", "_place", F.col("_l").alias("_low"), F.col("_h").alias("_high"), F.col("_start").alias("_before"))
        large = _renamed(large.select(*key), key)
        now = now.join(large, _same(now, large, key), "left_anti").select(finer.columns).unionByName(finer)
        level += 1
    until = F.col("_before") + F.sum("n").over(W.Window.partitionBy(*key).orderBy(v))
    ends = inside.select(*key, v.alias("_value"), "n", until.alias("_until"))
    met = _joined(ends, now, key)
    return met.filter((F.col("_place") <= F.col("_until")) & (F.col("_place") > F.col("_until") - F.col("n"))).select(*group, "_name", "_place", "_value")


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): exact quantiles with linear interpolation; nulls don't count.

    Values are counted first, before any shuffle, so that a value which most rows have is one row.
    """
    counted = sinks.stored(rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")))
    sizes = counted.groupBy(*group).agg(F.sum("n").alias("_size")).filter("_size > 0")
    exact = lambda share: 1 + share * (F.col("_size") - 1)
    wanted = [F.struct(F.lit(name).alias("_name"), side(exact(share)).cast("long").alias("_place"), (1 - F.abs(side(exact(share)) - exact(share))).alias("_weight")) for name, share in shares.items() for side in (F.floor, F.ceil)]
    sought = sinks.stored(sizes.select(*group, F.explode(F.array(*wanted)).alias("w")).select(*group, "w.*").filter("_weight > 0").distinct())
    found = values_at(counted, group, value, sought.drop("_weight"))
    weighted = _joined(found, sought, [*group, "_name", "_place"])
    return weighted.groupBy(*group).agg(*[F.sum(F.when(F.col("_name") == name, F.col("_value") * F.col("_weight"))).alias(name) for name in shares])
