"""Typed columns to numbers and states: imputation, category dictionaries, out-of-fold target encodings, embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import state
from ..schema import ValidationError, finite, quoted
from .numbering import numbered
from .quantiles import exact_quantiles, nested_thresholds

#: Up to so many categories a dictionary is broadcast or written into the plan.
BROADCAST_CATEGORIES = 100_000
MISSING_KEY = "<missing>"


def medians(df: DataFrame, columns: list[str], weight: str | None = None) -> dict[str, float]:
    """Median of the finite values of each column; 0 where there are none."""
    return {c: (q[0] if q else 0.0) for c, q in exact_quantiles(df, columns, [0.5], weight).items()}


def imputed(column: str, median: float) -> tuple[Column, Column]:
    """The column with missing and non-finite values replaced, and a 0/1 flag of where that was."""
    x = F.col(quoted(column)).cast("double")
    ok = finite(x)
    return F.when(ok, x).otherwise(F.lit(median)), (~F.coalesce(ok, F.lit(False))).cast("int")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """value, state: distinct values in ascending order, counted from 0 (one row for each category).

    Up to ``BROADCAST_CATEGORIES`` values are numbered by one window; beyond, ranges of them are (as int still: more
    than 2**31 categories are an error).
    """
    values = df.select(F.col(quoted(column)).alias("value")).where("value IS NOT NULL").distinct()
    if values.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES:
        return values.withColumn("state", (F.row_number().over(Window.orderBy("value")) - 1).cast("int"))
    return numbered(values, [F.col("value")], "state").withColumn("state", F.col("state").cast("int"))


def with_dictionary(df: DataFrame, column: str, table: DataFrame, value: str, default: Column, output: str) -> DataFrame:
    """Left join with a table keyed by ``value``; unseen and null values get ``default``.

    Small dictionaries are broadcast after their size has been checked, others joined by shuffle.
    """
    side = table.select(F.col("value").alias("__v"), F.col(value).alias("__s"))
    if side.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES:
        side = F.broadcast(side)
    return df.join(side, F.col(quoted(column)) == F.col("__v"), "left").withColumn(output, F.coalesce("__s", default)).drop("__v", "__s")


def category_states(df: DataFrame, column: str, output: str, reserve_missing: bool = True) -> DataFrame:
    """States by sorted value; null and unseen values get a last state of their own, or 0 if none is reserved."""
    table = dictionary(df, column)
    default = F.lit(table.count()) if reserve_missing else F.lit(0)
    return with_dictionary(df, column, table, "state", default, output)


def category_bits(state_column: Column, cardinality: int) -> list[Column]:
    """The binary digits of a state, lowest first."""
    return [F.shiftright(state_column, b).bitwiseAND(F.lit(1)).cast("int") for b in range(max(1, (cardinality - 1).bit_length()))]


def out_of_fold_scores(df: DataFrame, column: str, target: Column, fold: str, smoothing: float = 20.0, missing_as_key: bool = False, weight: Column | None = None) -> DataFrame:
    """Adds ``score``: the smoothed mean target of the row's category over all other folds.

    (sum + smoothing * overall mean) / (n + smoothing).  Per-fold sums are subtracted from totals, so the table is
    aggregated once; a hot category is one row after partial aggregation.  A category that only the row's fold has
    gets the other folds' overall mean; null categories too, unless they are a key of their own.
    """
    key = F.coalesce(F.col(quoted(column)).cast("string"), F.lit(MISSING_KEY)) if missing_as_key else F.col(quoted(column)).cast("string")
    w = weight if weight is not None else F.lit(1.0)
    rows = df.withColumn("__k", key)
    cells = rows.groupBy("__k", fold).agg(F.sum(target * w).alias("s"), F.sum(w).alias("n"))
    by_key, whole = Window.partitionBy("__k"), Window.partitionBy()
    rest_s, rest_n = F.sum("s").over(by_key) - F.col("s"), F.sum("n").over(by_key) - F.col("n")
    folds = cells.groupBy(fold).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))  # one row for each fold
    folds = folds.select(fold, ((F.sum("fs").over(whole) - F.col("fs")) / (F.sum("fn").over(whole) - F.col("fn"))).alias("__m"))
    mean = F.col("__m")  # outside a fold it is the same for all of its cells, null keys included
    table = cells.join(F.broadcast(folds), fold).select("__k", fold, F.when(F.col("__k").isNull(), mean).otherwise((rest_s + smoothing * mean) / (rest_n + smoothing)).alias("score"))
    joined = rows.alias("r").join(table.alias("t"), F.col("r.__k").eqNullSafe(F.col("t.__k")) & (F.col(f"r.{fold}") == F.col(f"t.{fold}")))
    return joined.select("r.*", "t.score").drop("__k")


def fitted_scores(df: DataFrame, column: str, target: Column, smoothing: float = 20.0, weight: Column | None = None) -> tuple[DataFrame, float]:
    """value, score over all rows, and the overall mean that unseen values get."""
    w = weight if weight is not None else F.lit(1.0)
    mean = df.agg(F.sum(target * w) / F.sum(w)).first()[0]
    rows = df.groupBy(F.col(quoted(column)).cast("string").alias("value")).agg(((F.sum(target * w) + smoothing * mean) / (F.sum(w) + smoothing)).alias("score"))
    return rows.where("value IS NOT NULL"), mean


def newton_scores(df: DataFrame, column: str, g: Column, h: Column, l2: float = 10.0) -> DataFrame:
    """value, score: sum of gradients over sum of Hessians plus ``l2`` for each category."""
    return df.groupBy(F.col(quoted(column)).cast("string").alias("value")).agg((F.sum(g) / (F.sum(h) + l2)).alias("score")).where("value IS NOT NULL")


def binned_scores(df: DataFrame, score: str, bins: int, output: str, shift: int = 1, null_state: int | None = 0, null_when: Column | None = None) -> DataFrame:
    """Scores to ordered states by their quantiles; ``shift`` leaves room for the state of nulls."""
    cuts = nested_thresholds(df, [score], (bins,), digits=9)[score][bins]
    s = state(F.round(F.col(score), 9), cuts) + F.lit(shift)
    return df.withColumn(output, (F.when(null_when, F.lit(null_state)).otherwise(s) if null_when is not None else s).cast("int"))


def category_mode(df: DataFrame, columns: list[str], most: int = 16) -> dict[str, str]:
    """"identity" for columns with at most ``most`` different values, else "ordered"."""
    # an estimate of all columns first: exact counts of several columns at once would multiply the rows
    guess = df.agg(*[F.approx_count_distinct(quoted(c), 0.02) for c in columns]).first()
    near = [c for c, n in zip(columns, guess, strict=True) if n <= 2 * most + 4]
    few = {c: df.select(F.col(quoted(c)).alias("c")).where("c IS NOT NULL").distinct().limit(most + 1).count() for c in near}
    return {c: "identity" if few.get(c, most + 1) <= most else "ordered" for c in columns}


# embeddings -------------------------------------------------------------------------------------------------------


def embedding_scale(df: DataFrame, column: str) -> DataFrame:
    """dim, mean, scale of each component (finite values; population deviation, 1 where it is nearly 0)."""
    long = df.select(F.posexplode(F.col(quoted(column))).alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x")).where(finite(F.col("x")))
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.when(F.stddev_pop("x") < 1e-8, F.lit(1.0)).otherwise(F.stddev_pop("x")).alias("scale"))


def class_centroids(df: DataFrame, column: str, target: str, weight: Column | None = None) -> DataFrame:
    """class, dim, mean: the mean embedding of each class."""
    long = df.select(F.col(target).alias("class"), (weight if weight is not None else F.lit(1.0)).alias("w"), F.posexplode(F.col(quoted(column))).alias("dim", "x"))
    return long.groupBy("class", "dim").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("mean"))


def centroid_direction(df: DataFrame, column: str, centroids: dict[int, list[float]]) -> Column:
    """Squared distance to class 0's centroid less that to class 1's."""
    x = F.col(quoted(column))
    far = lambda c: F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, d: s + d)
    return far(centroids[0]) - far(centroids[1])


def sound_vectors(df: DataFrame, column: str) -> tuple[Column, int]:
    """Which rows have a vector of the commonest length (the larger of equally common ones) without null or non-finite components, and that length."""
    x = F.col(quoted(column))
    lengths = df.where(x.isNotNull()).groupBy(F.size(x).alias("size")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    size = first["size"] if first else 0
    return F.coalesce((F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & finite(v.cast("double"))), F.lit(False)), size


@dataclass
class Moments:
    """Weights, sums and sums of products of vectors, by fold and class: what directions are made of, also without a fold.

    ``g[fold, class]`` is the weighted Gram matrix of a constant and the components.
    """

    g: np.ndarray

    @staticmethod
    def of(df: DataFrame, column: str, target: Column | None = None, fold: Column | None = None, folds: int = 1, weight: Column | None = None) -> Moments:
        """One pass.  ``target``: class 0 or 1 (null: no part); the driver holds the length squared for each fold and class."""
        sound, size = sound_vectors(df, column)
        rows = df.where(sound).select(
            (fold if fold is not None else F.lit(0)).cast("int").alias("f"), (target if target is not None else F.lit(0)).cast("int").alias("y"),
            (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), F.col(quoted(column)).cast("array<double>").alias("x"),
        ).where("y IN (0, 1) AND w > 0")
        shape = (folds, 2, size + 1, size + 1)

        def work(batches):
            total = np.zeros(shape)
            for batch in batches:
                f, y, w = (batch.column(i).to_numpy() for i in range(3))
                x = np.column_stack([np.ones(len(w)), batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(w), size)])
                for k in np.unique(f * 2 + y).tolist():
                    on = f * 2 + y == k
                    total[k // 2, k % 2] += x[on].T @ (x[on] * w[on, None])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["i", "x"])

        out = np.zeros(int(np.prod(shape)))
        got = rows.mapInArrow(work, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        out[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return Moments(out.reshape(shape))

    def rest(self, without: int | None = None) -> np.ndarray:
        """Both classes' Gram matrices over all folds, or over all but one."""
        total = self.g.sum(axis=0)
        return total if without is None else total - self.g[without]

    def scale(self) -> np.ndarray:
        """Population deviation of each component over all rows (1 where it is nearly 0)."""
        g = self.g.sum(axis=(0, 1))
        var = np.diag(g)[1:] / g[0, 0] - (g[0, 1:] / g[0, 0]) ** 2
        return np.where(var < 1e-16, 1.0, np.sqrt(np.maximum(var, 1e-16)))

    def centroid(self, without: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Offset and direction whose product with a vector is its squared distance (of scaled components) to class 0's centroid less that to class 1's."""
        g, s = self.rest(without), self.scale()
        if not g[0, 0, 0] > 0 or not g[1, 0, 0] > 0:
            return None
        c = [g[k, 0, 1:] / g[k, 0, 0] for k in (0, 1)]
        return (c[0] + c[1]) / 2, 2 * (c[1] - c[0]) / s**2

    def discriminant(self, without: int | None = None, shrink: float = 0.1, scaled: bool = True) -> tuple[np.ndarray, np.ndarray, float] | None:
        """Offset (of vectors), direction and constant of the linear discriminant, its covariance shrunk to its mean variance."""
        g = self.rest(without)
        s = self.scale() if scaled else np.ones(g.shape[-1] - 1)
        n = g[:, 0, 0]
        if not n.min() > 0:
            return None
        mean = g[:, 0, 1:] / n[:, None]
        cov = sum(g[k, 1:, 1:] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)) / n.sum() / np.outer(s, s)
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / len(s) * np.eye(len(s))
        w = np.linalg.solve(cov, (mean[1] - mean[0]) / s) / s
        return (mean[0] + mean[1]) / 2, w, float(np.log(n[1] / n[0]))

    def principal(self, k: int, scaled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, the ``k`` leading directions (rows; their largest entry is positive) and variances, over all rows."""
        g = self.g.sum(axis=(0, 1))
        mean, s = g[0, 1:] / g[0, 0], self.scale() if scaled else np.ones(len(g) - 1)
        values, vectors = np.linalg.eigh((g[1:, 1:] / g[0, 0] - np.outer(mean, mean)) / np.outer(s, s))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
        vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
        return mean, vectors / s, values


def principal_directions(df: DataFrame, column: str, k: int = 8, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the ``k`` leading directions and variances of an embedding column, see :meth:`Moments.principal`."""
    return Moments.of(df, column, weight=weight).principal(k)


def projected(column: str, mean: np.ndarray, directions: np.ndarray) -> Column:
    """The embedding in the coordinates of the directions, as an array."""
    x = F.zip_with(F.col(quoted(column)), F.array(*map(F.lit, mean.tolist())), lambda a, m: a.cast("double") - m)
    dot = lambda d: F.aggregate(F.zip_with(x, F.array(*map(F.lit, d.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[dot(d) for d in directions])


def prototypes(df: DataFrame, column: str, target: str, per_class: int = 64, rounds: int = 10, weight: Column | None = None, scale: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """k-means centres of each class (0 and 1) over all rows, see :func:`fold_prototypes`."""
    return fold_prototypes(df, column, target, None, 0, per_class, rounds, weight, scale)[0]


def fold_prototypes(df: DataFrame, column: str, target: str, fold: Column | None, folds: int, per_class: int = 64, rounds: int = 10, weight: Column | None = None, scale: np.ndarray | None = None) -> list[dict[int, np.ndarray]]:
    """k-means centres of each class (0 and 1): without each of some folds, and (the last) over all rows.

    A start's centres are the rows with the smallest hashes of their values.  Distances are those of components divided
    by ``scale``.  Each round is one aggregation for all folds; the driver holds the centres.
    """
    sound, size = sound_vectors(df, column)
    s = np.ones(size) if scale is None else scale
    rows = df.where(sound).select(F.col(quoted(target)).cast("int").alias("y"), F.coalesce(fold, F.lit(-1)).cast("int").alias("f") if fold is not None else F.lit(-1).alias("f"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), F.col(quoted(column)).cast("array<double>").alias("x")).where("y IN (0, 1) AND w > 0")
    unlike = rows.select("y", "f", "x", F.xxhash64("x").alias("h")).distinct()
    some = unlike.withColumn("r", F.row_number().over(Window.partitionBy("y", "f", F.pmod("h", F.lit(64))).orderBy("h", "x"))).where(F.col("r") <= per_class)
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("y", "f").orderBy("h", "x"))).where(F.col("r") <= per_class).select("y", "f", "h", "x").collect()  # (folds * 2 * per_class) rows
    centres = []
    for k in range(folds + 1):
        own = sorted((r for r in first if r["f"] != k or k == folds), key=lambda r: (r["h"], r["x"]))
        centres.append({c: np.array(list(dict.fromkeys(tuple(r["x"]) for r in own if r["y"] == c))[:per_class]).reshape(-1, size) / s for c in (0, 1)})
    shape = (folds + 1, 2, per_class, size + 1)
    for _ in range(rounds):

        def work(batches, now=centres):
            total = np.zeros(shape)
            for batch in batches:
                y, f, w = (batch.column(i).to_numpy() for i in range(3))
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), size) / s
                ones = np.column_stack([np.ones(len(y)), x]) * w[:, None]
                for k, both in enumerate(now):
                    for c, v in both.items():
                        on = (y == c) & ((f != k) | (k == folds))
                        if len(v) and on.any():
                            near = ((v**2).sum(axis=1) - 2 * x[on] @ v.T).argmin(axis=1)
                            np.add.at(total[k, c], near, ones[on])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["i", "x"])

        sums = np.zeros(int(np.prod(shape)))
        got = rows.mapInArrow(work, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        sums[got.column(0).to_numpy()] = got.column(1).to_numpy()
        sums = sums.reshape(shape)
        moved = 0.0
        for k, both in enumerate(centres):
            for c, v in both.items():
                t = sums[k, c, : len(v)]
                new = np.where(t[:, :1] > 0, t[:, 1:] / np.maximum(t[:, :1], 1e-300), v)
                moved = max(moved, np.abs(new - v).max(initial=0.0))
                both[c] = new
        if moved < 1e-12:
            break
    return [{c: v * s for c, v in both.items()} for both in centres]


def prototype_score(column: str, centres: dict[int, np.ndarray], scale: np.ndarray | None = None) -> Column:
    """Distance (of components divided by ``scale``) to the nearest prototype of class 0 less that to the nearest of class 1."""
    if scale is not None:
        x = F.zip_with(F.col(quoted(column)), F.array(*map(F.lit, scale.tolist())), lambda a, b: a.cast("double") / b)
        centres = {c: v / scale for c, v in centres.items()}
    else:
        x = F.col(quoted(column))
    far = lambda p: F.aggregate(F.zip_with(x, F.array(*map(F.lit, p.tolist())), lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, d: s + d)
    nearest = lambda c: F.sqrt(F.array_min(F.array(*[far(p) for p in centres[c]])))
    return nearest(0) - nearest(1)


def discriminant_direction(df: DataFrame, column: str, target: str, shrink: float = 0.1, weight: Column | None = None) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear discriminant of two classes with a covariance shrunk to its mean variance."""
    found = Moments.of(df, column, F.col(quoted(target)), weight=weight).discriminant(shrink=shrink, scaled=False)
    if found is None:
        raise ValidationError("both classes need vectors")
    middle, w, constant = found
    return w, float(constant - w @ middle)


#: Distances that one block of queries computes in one pass.
BLOCK_DISTANCES = 100_000_000


def knn_probability(df: DataFrame, key: str, column: str, target: str, is_query: Column, k: int | list[int] = 5, fold: Column | None = None, block_distances: int = BLOCK_DISTANCES) -> DataFrame:
    """``key``, probability: distance-weighted share of class 1 among the ``k`` nearest other rows (a list: an array).

    ``fold``: neighbours are sought in other folds only.  A stated set of queries against all rows, in blocks: rows are
    dealt to shards, queries to blocks, and every shard answers each block's queries with their ``k`` nearest.
    """
    ks = [k] if isinstance(k, int) else list(k)
    rows = df.select(F.col(key).alias("id"), F.col(quoted(column)).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), is_query.alias("q"), (fold if fold is not None else F.lit(-1)).cast("int").alias("fold")).where(F.col("x").isNotNull())
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    root = max(1, int(block_distances**0.5))
    shards, blocks = max(1, -(-n // root)), max(1, -(-asked // root))
    deal = lambda count, by: F.pmod(F.xxhash64(by), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    points = rows.select(deal(shards, F.col("id")).alias("shard"), every(blocks).alias("block"), "id", "x", "y", "fold")
    queries = rows.where("q").select(every(shards).alias("shard"), deal(blocks, F.concat(F.col("id").cast("string"), F.lit("q"))).alias("block"), "id", "x", "fold")
    most, by_fold = max(ks), fold is not None
    id_type = rows.schema["id"].dataType.simpleString()

    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if points.num_rows and queries.num_rows:
            order = points.column("id").to_numpy().argsort(kind="stable")
            points = points.take(pa.array(order))
            matrix = lambda t: t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            x, ids, folds, q, q_ids, q_folds = matrix(points), points.column("id").to_numpy(), points.column("fold").to_numpy(), matrix(queries), queries.column("id").to_numpy(), queries.column("fold").to_numpy()
            y, square, top = points.column("y").to_numpy(), (x**2).sum(axis=1), min(most, len(x)) - 1
            step = max(1, 4_000_000 // len(x))
            for a in range(0, len(q), step):
                # a product finds who can be among the nearest, up to its rounding; sums of squares decide
                rough = square - 2 * (q[a : a + step] @ x.T)
                rough[(ids == q_ids[a : a + step, None]) | (by_fold & (folds == q_folds[a : a + step, None]))] = np.inf
                limit = np.partition(rough, top, axis=1)[:, top]
                room = 1e-8 + 1e-9 * (square.max() + (q[a : a + step] ** 2).sum(axis=1))
                who, near = np.nonzero(rough <= np.where(np.isfinite(limit), limit + room, np.finfo(float).max)[:, None])
                d = np.zeros(len(who))
                for j in range(x.shape[1]):  # in this order, so that equal rows get equal sums
                    d += (x[near, j] - q[a + who, j]) ** 2
                d = np.round(d, 9)
                order = np.lexsort((near, d, who))  # ties: smaller ids first
                who, near, d = who[order], near[order], d[order]
                best = np.arange(len(who)) - np.searchsorted(who, who) < most
                for o, v in zip(out, (q_ids[a + who[best]], d[best], ids[near[best]], y[near[best]]), strict=True):
                    o.append(v)
        flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        kind = queries.schema.field("id").type
        return pa.table([pa.array(flat[0]).cast(kind), pa.array(flat[1], pa.float64()), pa.array(flat[2]).cast(kind), pa.array(flat[3], pa.float64())], names=["qid", "d2", "id", "y"])

    near = points.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(search, f"qid {id_type}, d2 double, id {id_type}, y double")
    nearest = Window.partitionBy("qid").orderBy("d2", "id")
    best = near.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= most)
    w = 1.0 / (F.sqrt("d2") + 1e-9)
    share = [F.sum(F.when(F.col("r") <= j, w * F.col("y"))) / F.sum(F.when(F.col("r") <= j, w)) for j in ks]
    return best.groupBy(F.col("qid").alias(key)).agg((share[0] if isinstance(k, int) else F.array(*share)).alias("probability"))


def packed_states(df: DataFrame, cardinality: dict[str, int]) -> DataFrame:
    """State columns in the smallest integer type that holds them."""
    kind = lambda n: "tinyint" if n <= 128 else "smallint" if n <= 32_768 else "int"
    return df.select(*[F.col(quoted(c)).cast(kind(cardinality[c])).alias(c) if c in cardinality else F.col(quoted(c)) for c in df.columns])
