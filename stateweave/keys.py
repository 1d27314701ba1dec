"""Splits and folds as functions of a unique key, so that they don't depend on the order of rows or on partitions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scramble(key: Column, seed: int = 0) -> Column:
    """A fixed scrambling of an integer key into 0..1000002."""
    return F.pmod(key.cast("bigint") * 7919 + F.lit(seed), F.lit(1_000_003))


def hashed_fold(key: Column, folds: int, seed: int = 0) -> Column:
    """A fold for each key without any shuffle: sizes are equal on average, not exactly."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def _placed(df: DataFrame, key: str, target: str, seed: int) -> tuple[DataFrame, list[str]]:
    """``df`` with each row's place among its target value in scrambled order and the number of such rows.

    Scrambled keys fall into 1,024 equal ranges; a window sorts one range of one target value, and ranges go on from the
    counts of those before (one row for each target value and range), so a frequent value is never sorted in one task.
    """
    near, local, ahead, n = (f"__{x}_{len(df.columns)}" for x in ("range", "local", "ahead", "n"))
    at = F.floor(scramble(F.col(key), seed) * 1024 / 1_000_003).cast("int")
    rows = df.withColumn(near, F.coalesce(at, F.lit(-1)))
    counts = rows.groupBy(target, near).agg(F.count("*").alias(local))
    whole = Window.partitionBy(target)
    before = F.coalesce(F.sum(local).over(whole.orderBy(near).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(target).alias("__t"), F.col(near).alias("__r"), before.alias(ahead), F.sum(local).over(whole).alias(n))
    inside = Window.partitionBy(target, near).orderBy(scramble(F.col(key), seed), F.col(key))
    rows = rows.withColumn(local, F.row_number().over(inside))
    joined = rows.join(counts, F.col(target).eqNullSafe(F.col("__t")) & (F.col(near) == F.col("__r")))
    return joined.withColumn(local, F.col(local) + F.col(ahead)).drop("__t", "__r", near, ahead), [local, n]


def stratified_folds(df: DataFrame, key: str, target: str, folds: int, seed: int = 0) -> DataFrame:
    """Column ``fold``: inside each target value, keys in scrambled order are dealt in turn (sizes differ by one at most)."""
    placed, (place, n) = _placed(df, key, target, seed)
    return placed.withColumn("fold", F.pmod(F.col(place) - 1, F.lit(folds)).cast("int")).drop(place, n)


def stratified_subsample(df: DataFrame, key: str, target: str, fraction: float, least: int = 8, seed: int = 0) -> DataFrame:
    """Of each target value ``max(least, ceil(fraction * n))`` rows, the first in scrambled order."""
    placed, (place, n) = _placed(df, key, target, seed)
    return placed.where(F.col(place) <= F.greatest(F.lit(least), F.ceil(F.col(n) * F.lit(fraction)))).drop(place, n)


def column_sample(columns: list[str], fraction: float, seed: int) -> list[str]:
    """A seeded subset of columns, in their order; one at least."""
    n = max(1, round(fraction * len(columns)))
    chosen = set(random.Random(seed).sample(range(len(columns)), n))
    return [c for i, c in enumerate(columns) if i in chosen]
