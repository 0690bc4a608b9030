"""Deterministic splits of clips for training and validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import places

#: Fixed value: the share that validation has of each language.
VALIDATION = 0.1


def stratified(rows: DataFrame, group: str = "language_code", key: str = "segment_key", share: float = VALIDATION) -> DataFrame:
    """``rows`` with split: of each group, in order of the key, the last floor(share n) rows, one at least, are val.

    A null group is a group. No task orders a whole group, see ``ranking.places``.
    """
    last_train = F.col("_size") - F.greatest(F.lit(1), F.floor(F.col("_size") * share))
    return places(rows, [group], [key], "_place").withColumn("split", F.when(F.col("_place") > last_train, "val").otherwise("train")).drop("_place", "_size")


def by_column(split: Column) -> Column:
    """train stays, dev becomes val, all else is in neither."""
    return F.when(split == "train", "train").when(split == "dev", "val")


def validation_rows(n: int, share: float = VALIDATION) -> int:
    return max(1, math.floor(n * share))
