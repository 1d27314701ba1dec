"""Exact row numbers without a window that puts a whole table, or a whole group, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.interim import stored


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"__n{i}" for i in range(len(taken) + n)) if c not in taken][:n]


def numbered(df: DataFrame, order: list[Column], name: str, group: list[str] | None = None, first: int = 0) -> DataFrame:
    """``df`` with each row's place (long) in the given order, counted from ``first`` inside each group; null is a group.

    Rows are dealt to ranges of (group, order) and numbered inside each range.  A group goes on from one range to the
    next at the count of its rows so far: at most one group crosses each border, so these counts are fewer than the
    ranges and are broadcast.  Rows that agree in the whole order are told apart by where they were read, so that
    repeated rows can't fill one range.  The dealt rows are stored once, which fixes the borders.
    """
    keys = [f"`{c}`" for c in group or []]
    part, row, local, ahead = free_names(df, 4)
    dealt = df.withColumn(row, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order, F.col(row))
    rows = stored(dealt.withColumn(part, F.spark_partition_id()))
    inside = rows.withColumn(local, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order, row)))
    counts = rows.groupBy(*keys, part).agg(F.count("*").alias(local))
    so_far = F.sum(local).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    continued = counts.withColumn(ahead, so_far).where(F.col(ahead).isNotNull()).drop(local)
    same = F.col(f"r.{part}") == F.col(f"c.{part}")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = inside.alias("r").join(F.broadcast(continued.alias("c")), same, "left")
    place = F.col(f"r.{local}") + F.coalesce(F.col(f"c.{ahead}"), F.lit(0)) + F.lit(first - 1)
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns], place.cast("bigint").alias(name))
