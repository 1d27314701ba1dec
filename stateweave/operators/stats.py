"""Statistics of states as plain aggregations.

Rows are turned into (feature, state) cells by an explode that is followed at once by a partial aggregation, so what is
shuffled are cells: a few thousand rows a task, whatever the table's size.  Everything after that works on cells.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import quoted


def state_cells(df: DataFrame, features: list[str], keys: list[str] = (), sums: dict[str, Column] | None = None, weight: Column | None = None) -> DataFrame:
    """feature, state, ``keys``, n (rows or their weight) and sums: the histogram of every feature in one pass."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(quoted(f)).cast("int").alias("state")) for f in features])
    return _cells(df, entries, ["feature", "state"], keys, sums, weight)


def tuple_cells(df: DataFrame, tuples: list[tuple[str, ...]], keys: list[str] = (), sums: dict[str, Column] | None = None, weight: Column | None = None) -> DataFrame:
    """f0, f1, ..., s0, s1, ... with the same sums: joint histograms of pairs or triples of features."""
    size = len(tuples[0])
    entries = F.array(*[F.struct(*[F.lit(f).alias(f"f{i}") for i, f in enumerate(t)], *[F.col(quoted(f)).cast("int").alias(f"s{i}") for i, f in enumerate(t)]) for t in tuples])
    return _cells(df, entries, [*(f"f{i}" for i in range(size)), *(f"s{i}" for i in range(size))], keys, sums, weight)


def _cells(df: DataFrame, entries: Column, names: list[str], keys: list[str], sums: dict[str, Column] | None, weight: Column | None) -> DataFrame:
    sums = sums or {}
    wide = df.select(*[quoted(k) for k in keys], *[c.alias(f"__{n}") for n, c in sums.items()], (weight if weight is not None else F.lit(1)).alias("__w"), F.explode(entries).alias("__e"))
    n = F.sum("__w") if weight is not None else F.count("*")
    return wide.groupBy(*[F.col(f"__e.{x}").alias(x) for x in names], *keys).agg(n.alias("n"), *[F.sum(f"__{s}").alias(s) for s in sums])


def pairs_of(features: list[str]) -> list[tuple[str, str]]:
    return list(combinations(features, 2))


def mutual_information(cells: DataFrame, by: list[str], state: list[str], target: str, n: str = "n") -> DataFrame:
    """``by``, mi: information in nats between ``state`` and ``target``, from cell counts."""
    whole, row, column = Window.partitionBy(*by), Window.partitionBy(*by, *state), Window.partitionBy(*by, target)
    joint = F.col(n) / F.sum(n).over(whole)
    term = joint * F.log(F.col(n) * F.sum(n).over(whole) / (F.sum(n).over(row) * F.sum(n).over(column)))
    return cells.where(F.col(n) > 0).withColumn("__t", term).groupBy(*by).agg(F.sum("__t").alias("mi"))


def mean_label_information(cells: DataFrame, by: list[str], state: list[str], label: str, target: str, n: str = "n") -> DataFrame:
    """``by``, mi: mean information over those labels that aren't constant."""
    each = mutual_information(cells, [*by, label], state, target, n)
    varied = cells.where(F.col(n) > 0).groupBy(label).agg(F.count_distinct(target).alias("__d")).where("__d > 1").select(label)
    return each.join(F.broadcast(varied), label).groupBy(*by).agg(F.avg("mi").alias("mi"))


def newton_gain(cells: DataFrame, by: list[str], l2: float = 5.0, parent: bool = False, g: str = "g", h: str = "h") -> DataFrame:
    """``by``, gain: half the sum of G^2/(H + l2) over cells; with ``parent`` less what one cell for all would give."""
    child = F.sum(F.col(g) ** 2 / (F.col(h) + l2))
    if parent:
        child = F.greatest(child - F.sum(g) ** 2 / (F.sum(h) + l2), F.lit(0.0))
    return cells.groupBy(*by).agg((child / 2).alias("gain"))


def between_share(cells: DataFrame, by: list[str], value: str = "v", square: str = "vv", n: str = "n") -> DataFrame:
    """``by``, eta2: share of the variance that lies between cells."""
    mean = F.sum(value) / F.sum(n)
    between = F.sum(F.col(value) ** 2 / F.col(n)) - F.sum(n) * mean**2
    return cells.where(F.col(n) > 0).groupBy(*by).agg((between / (F.sum(square) - F.sum(n) * mean**2)).alias("eta2"))


def interaction_anova(cells: DataFrame, value: str = "v", n: str = "n") -> DataFrame:
    """f0, f1, score: mean squared departure of a pair's cell means from the sum of its two main effects."""
    w = lambda *k: Window.partitionBy("f0", "f1", *k)
    mean = lambda *k: F.sum(value).over(w(*k)) / F.sum(n).over(w(*k))
    left, right, whole = mean("s0"), mean("s1"), mean()
    d = F.col(value) / F.col(n) - left - right + whole
    scored = cells.where(F.col(n) > 0).withColumn("__d", F.col(n) * d**2)
    return scored.groupBy("f0", "f1").agg((F.sum("__d") / F.sum(n)).alias("score"))


def block_gains(cells: DataFrame, rows: int, l2: float = 5.0, support_share: float = 0.05, least: int = 20, least_hessian: float = 1.0, by: list[str] = ()) -> DataFrame:
    """Conditional blocks: for each directed pair (gate f0, target f1) and gate state s0, the gain of splitting by s1.

    Kept are gate states with enough rows and Hessian and more than one cell in use.
    """
    group = cells.where("n > 0").groupBy(*by, "f0", "f1", F.col("s0").alias("gate_state"))
    child = F.sum(F.col("g") ** 2 / (F.col("h") + l2))
    whole = F.sum("g") ** 2 / (F.sum("h") + l2)
    out = group.agg((F.greatest(child - whole, F.lit(0.0)) / 2).alias("gain"), F.sum("n").cast("bigint").alias("support"), F.sum("h").alias("hessian"), F.count("*").alias("active"))
    return out.where((F.col("support") >= max(least, -int(-support_share * rows // 1))) & (F.col("hessian") >= least_hessian) & (F.col("active") > 1))


def stable_score(a: Column, b: Column, cardinality: int) -> Column:
    """Harmonic mean of two halves' gains, damped by how unlike they are, by table size."""
    return F.when((a > 0) & (b > 0), 2 * a * b / (a + b) * F.sqrt(F.least(a, b) / F.greatest(a, b)) / F.sqrt(F.lit(8.0 * cardinality))).otherwise(F.lit(0.0))


def gram(df: DataFrame, columns: list[str], weight: Column | None = None) -> list[list[float]]:
    """Sums of products of all pairs of columns (a constant first), in one aggregate: for up to some dozens of columns."""
    w = weight if weight is not None else F.lit(1.0)
    cols = [F.lit(1.0), *[F.col(quoted(c)).cast("double") for c in columns]]
    size = len(cols)
    row = df.agg(*[F.sum(w * cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(size) for j in range(i, size)]).first()
    return [[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)]


def log_loss(y: Column, p: Column, floor: float = 1e-15) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def pinball(y: Column, prediction: Column, quantile: float) -> Column:
    d = y - prediction
    return F.greatest(quantile * d, (quantile - 1) * d)


def mean_and_error(df: DataFrame, loss: Column) -> DataFrame:
    """loss, standard_error: mean of a loss and the standard error of that mean."""
    return df.agg(F.avg(loss).alias("loss"), (F.stddev_samp(loss) / F.sqrt(F.count(loss))).alias("standard_error"))


def best_f1_threshold(df: DataFrame, score: str, target: str, shrink: float = 0.25, weight: Column | None = None, buckets: int = 1024) -> DataFrame:
    """threshold, f1: the score at which F1 is largest, kept inside .05 to .95 and drawn to 0.5.

    Works on one row for each different score; running sums are taken over ``buckets`` ranges of scores first, then
    inside each range.
    """
    w = weight if weight is not None else F.lit(1)
    cells = df.groupBy(F.col(score).alias("t")).agg(F.sum(w).alias("n"), F.sum(w * F.col(target)).alias("p"))
    edge = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    wide = (F.col("hi") - F.col("lo")) / buckets
    cells = cells.join(F.broadcast(edge)).withColumn("b", F.when(wide > 0, F.floor((F.col("t") - F.col("lo")) / wide)).otherwise(0)).drop("lo", "hi")
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = cells.groupBy("b").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))  # at most buckets + 1 rows
    ranges = ranges.select("b", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.sum("bp").over(every).alias("all"))
    down = Window.partitionBy("b").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    p, n = F.col("ap") + F.sum("p").over(down), F.col("an") + F.sum("n").over(down)
    f1 = 2 * p / (n + F.col("all"))
    best = cells.join(F.broadcast(ranges), "b").select("t", f1.alias("f1")).orderBy(F.desc("f1"), F.desc("t")).limit(1)
    inside = F.greatest(F.least(F.col("t"), F.lit(0.95)), F.lit(0.05))
    return best.select((F.lit(shrink) * 0.5 + (1 - shrink) * inside).alias("threshold"), "f1")


def bernstein_bound(df: DataFrame, value: Column, bound: float, delta: float = 0.05) -> DataFrame:
    """mean, lower: a lower confidence bound of a mean from its sample variance (values within +-bound)."""
    log = F.log(F.lit(2.0 / delta))
    n = F.count(value)
    lower = F.avg(value) - F.sqrt(2 * F.var_samp(value) * log / n) - 7 * bound * log / (3 * (n - 1))
    return df.agg(F.avg(value).alias("mean"), lower.alias("lower"))


def class_gains(cells: DataFrame, by: list[str], l2: float = 10.0, least: int = 12) -> DataFrame:
    """``by``, gain: half the sum over classes of G^2/(H + l2), over states with enough rows.

    ``cells`` has a row for each state and class with the state's rows ``n`` and the class's sums ``g`` and ``h``.
    """
    return cells.where(F.col("n") >= least).groupBy(*by).agg((F.sum(F.col("g") ** 2 / (F.col("h") + l2)) / 2).alias("gain"))


def class_cells(df: DataFrame, features: list[str], classes: list, code: str, probabilities: list[Column], weight: Column | None = None) -> DataFrame:
    """feature, state, class, n, g, h: for every state, sums of residuals and Hessians of each class (one pass).

    ``code``: the row's class as an index into ``classes``; ``probabilities``: one column for each.
    """
    w = weight if weight is not None else F.lit(1.0)
    sums = {f"g{i}": w * ((F.col(code) == i).cast("double") - p) for i, p in enumerate(probabilities)} | {f"h{i}": w * p * (1 - p) for i, p in enumerate(probabilities)}
    wide = state_cells(df, features, sums=sums, weight=w)
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"g{i}").alias("g"), F.col(f"h{i}").alias("h")) for i, c in enumerate(classes)])
    return wide.select("feature", "state", "n", F.explode(each).alias("e")).select("feature", "state", "n", "e.*")


def class_descriptors(cells: DataFrame, features: list[str], l2: float = 10.0, least: int = 12, screened: int = 24, per_class: int = 3, most: int = 12) -> DataFrame:
    """class, feature, state, score, rank: states whose class residuals call for a correction of their own.

    From the ``screened`` best features by :func:`class_gains`; the ``per_class`` best states of each class, ``most`` in all.
    """
    from .rank import position, top_features

    best = top_features(class_gains(cells, ["feature"], l2, least), features, "gain", screened).select("feature")
    scored = cells.where(F.col("n") >= least).join(F.broadcast(best), "feature").withColumn("score", F.round(F.col("g") ** 2 / (F.col("h") + l2) / 2, 9))
    scored = scored.withColumn("idx", position(features, F.col("feature")))
    order = [F.desc("score"), "class", "idx", "state"]
    own = scored.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(F.col("k") <= per_class)
    top = own.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("class", "feature", "state", "score", "rank")
