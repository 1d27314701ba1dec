"""Rankings and top-k selections, with every tie decided by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 9


def position(features: list[str], name: Column) -> Column:
    """Index of a feature in its table's order."""
    return (F.array_position(F.array(*map(F.lit, features)), name) - 1).cast("int")


def top_features(scores: DataFrame, features: list[str], score: str, k: int) -> DataFrame:
    """The ``k`` best features; of equal ones the earlier column.  Adds ``rank``.  One row for each feature is ranked."""
    ranked = scores.withColumn(score, F.round(score, DIGITS)).withColumn("idx", position(features, F.col("feature")))
    order = Window.orderBy(F.desc(score), "idx")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_marginals(pairs: DataFrame, singles: DataFrame, score: str, how: str = "max") -> DataFrame:
    """Pair scores less the larger (``max``) or the sum (``sum``) of the two single scores, as ``excess``."""
    left = singles.select(F.col("feature").alias("f0"), F.col(score).alias("__l"))
    right = singles.select(F.col("feature").alias("f1"), F.col(score).alias("__r"))
    base = F.greatest("__l", "__r") if how == "max" else F.col("__l") + F.col("__r")
    return pairs.join(F.broadcast(left), "f0").join(F.broadcast(right), "f1").withColumn("excess", F.col(score) - base).drop("__l", "__r")


def top_pairs(pairs: DataFrame, features: list[str], score: str, k: int, second: str | None = None, later_first: bool = True) -> DataFrame:
    """The ``k`` best pairs by ``score``, then ``second``; of equal ones the later (or earlier) columns.  Adds ``rank``."""
    out = pairs.withColumn(score, F.round(score, DIGITS))
    if second:
        out = out.withColumn(second, F.round(second, DIGITS))
    i, j = position(features, F.col("f0")), position(features, F.col("f1"))
    tie = [F.desc("i0"), F.desc("i1")] if later_first else [F.asc("i0"), F.asc("i1")]
    out = out.withColumn("i0", i).withColumn("i1", j)
    order = [F.desc(score), *([F.desc(second)] if second else []), *tie]
    best = out.orderBy(*order).limit(k)  # every task keeps its own best k; the window sees k rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("i0", "i1")


def round_robin(ranked: DataFrame, direction: str, rank: str, item: str, k: int) -> DataFrame:
    """Items in turn from every direction's ranking (first places of all, then second ones), each once, ``k`` in all."""
    first = ranked.groupBy(item).agg(F.min(F.struct(F.col(rank).alias("r"), F.col(direction).alias("d"))).alias("m"))
    order = Window.orderBy("m.r", "m.d", item)
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(item, "rank")


def top_in_group(df: DataFrame, group: str, score: str, ties: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group."""
    order = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tie_safe_top(df: DataFrame, score: str, k: int) -> DataFrame:
    """The ``k`` best rows and all that tie with the last of them (null scores never are; fewer rows: all of them)."""
    last = df.where(F.col(score).isNotNull()).select(F.col(score).alias("__s")).orderBy(F.desc("__s")).limit(k).agg(F.min("__s").alias("__s"))
    return df.join(F.broadcast(last), F.col(score) >= F.col("__s")).drop("__s")  # one row


def two_stage(pairs: DataFrame, features: list[str], first: str, second: str, k: int, factor: int = 4) -> DataFrame:
    """The best ``factor * k`` by ``first``, of those the best ``k`` by ``second``."""
    return top_pairs(top_pairs(pairs, features, first, factor * k).drop("rank"), features, second, k)


def label_pairs(scores: DataFrame, how: str = "mean") -> DataFrame:
    """f0, f1, excess, mi from scores of pairs for each label: their mean, their max, or half of each (``mean_max``)."""
    over = {"mean": F.avg, "max": F.max, "mean_max": lambda c: (F.avg(c) + F.max(c)) / 2}[how]
    return scores.groupBy("f0", "f1").agg(over("excess").alias("excess"), over("mi").alias("mi"))


def diversified(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """f0, f1, rank: two thirds of ``k`` pairs from one ranking, then the rest from another, each once; gaps are refilled.

    Both rankings (f0, f1, rank) are a few times ``k`` long.
    """
    quota = (2 * k + 2) // 3
    one = first.select("f0", "f1", F.col("rank").alias("r1"))
    both = one.join(second.select("f0", "f1", F.col("rank").alias("r2")), ["f0", "f1"], "full")
    # the second ranking's turn: its first pairs that the first one's quota has not taken
    taken = F.coalesce(F.col("r1") <= quota, F.lit(False))
    turn = Window.partitionBy(taken).orderBy(F.col("r2").asc_nulls_last(), "f0", "f1")
    later = both.withColumn("taken", taken).withColumn("turn", F.when(~F.col("taken") & F.col("r2").isNotNull(), F.row_number().over(turn)))
    quick = F.coalesce(F.col("turn") <= k - quota, F.lit(False))
    group = F.when(F.col("taken"), 0).when(quick, 1).when(F.col("r1").isNotNull(), 2).otherwise(3)
    place = F.when(F.col("taken") | (group == 2), F.col("r1")).otherwise(F.col("r2"))
    order = Window.orderBy("group", "place", "f0", "f1")
    out = later.withColumn("group", group).withColumn("place", place)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("f0", "f1", "rank")


def cost_adjusted(gains: DataFrame, rows: int, cardinality: Column, per_byte: float = 0.0, per_step: float = 0.0) -> DataFrame:
    """Adds ``score`` to block gains (f0, f1, gate_state, gain): gain a row less the cost of bytes and steps, by table size.

    Blocks whose gain doesn't cover a cost go.
    """
    size = 8.0 * cardinality + 16.0
    net = F.col("gain") / max(rows, 1) - per_byte * size - 2 * per_step
    out = gains.withColumn("score", net / F.sqrt(size))
    return out.where(net > 0) if per_byte or per_step else out


def top_blocks(blocks: DataFrame, features: list[str], score: str, k: int) -> DataFrame:
    """The ``k`` best blocks (f0, gate_state, f1, gain) by ``score``, then gain, then later columns.  Adds ``rank``."""
    out = blocks.withColumn(score, F.round(score, 12)).withColumn("gain", F.round("gain", DIGITS))
    out = out.withColumn("i0", position(features, F.col("f0"))).withColumn("i1", position(features, F.col("f1")))
    order = [F.desc(score), F.desc("gain"), F.desc("i0"), F.desc("gate_state"), F.desc("i1")]
    return out.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("i0", "i1")


def full_and_stable(halves: DataFrame, features: list[str], rows: int, cardinality: int, k: int, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame, bool]:
    """Both rankings of blocks from one table of cells (f0, f1, s0, s1, half, n, g, h), and whether a boundary is a near tie.

    A near tie (scores on both sides of rank ``k`` closer than ``tolerance`` of the best one) means that rounding could
    decide; the caller may then want more blocks.
    """
    from .stats import block_gains, stable_score

    whole = halves.groupBy("f0", "f1", "s0", "s1").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")])
    full = cost_adjusted(block_gains(whole, rows), rows, F.lit(float(cardinality)))
    each = block_gains(halves, rows // 2, least=10, by=["half"])
    side = lambda v: F.max(F.when(F.col("half") == v, F.col("gain")))
    split = each.groupBy("f0", "f1", "gate_state").agg(side(0).alias("a"), side(1).alias("b")).where("a > 0 AND b > 0")
    stable = split.withColumn("score", stable_score(F.col("a"), F.col("b"), cardinality)).join(full.select("f0", "f1", "gate_state", "gain"), ["f0", "f1", "gate_state"])
    tops = [top_blocks(blocks, features, "score", k + 1) for blocks in (full, stable)]
    return tops[0].where(F.col("rank") <= k), tops[1].where(F.col("rank") <= k), any(boundary_gap(t, k) <= tolerance for t in tops)


def boundary_gap(ranked: DataFrame, k: int) -> float:
    """How far the ``k``-th score is above the next one, in units of the best score's size; infinite if there is no next one."""
    score = {r["rank"]: r["score"] for r in ranked.where(F.col("rank").isin(1, k, k + 1)).select("rank", "score").collect()}
    if k + 1 not in score:
        return float("inf")
    gap, size = score[k] - score[k + 1], abs(score[1])
    return gap / size if size else 0.0
