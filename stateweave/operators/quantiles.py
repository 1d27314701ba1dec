"""Exact quantiles, weighted quantiles and the thresholds of nested states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ValidationError, finite, quoted

#: Up to so many values (rows times columns) the built-in exact percentile is used; beyond, its buffers (every distinct
#: value of all columns, in one task) could outgrow it, and ranks are narrowed down by histograms instead.  Both are exact.
BUFFER_VALUES = 20_000_000
#: Cells of all histograms of a pass together.
CELLS = 2**17


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], weight: str | None = None) -> dict[str, list[float]]:
    """Linear (type 7) quantiles of the finite values of each column; an empty list for a column without any.

    ``weight``: whole numbers repeat their rows; others give the linear quantiles of the midpoint distribution.
    """
    w = F.col(quoted(weight)).cast("double") if weight else F.lit(1.0)
    values = df.select(*[F.when(finite(F.col(quoted(c)).cast("double")), F.col(quoted(c)).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)], w.alias("w")).where("w > 0")
    n, whole = values.agg(F.count("*"), F.coalesce(F.bool_and(F.col("w") == F.rint("w")), F.lit(True))).first()
    if whole and n * len(columns) <= BUFFER_VALUES:
        frequency = F.col("w").cast("bigint") if weight else F.lit(1)
        row = values.agg(*[F.percentile(f"v{i}", F.array(*map(F.lit, probabilities)), frequency).alias(f"q{i}") for i in range(len(columns))]).first()
        return {c: list(row[i] or []) for i, c in enumerate(columns)}
    return _narrowed(values, columns, probabilities, not whole)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _histograms(values: DataFrame, k: int, ranges: list[tuple[int, float, float]], by_value: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each range (column, lowest, highest) the weight, lowest and highest value of its cells in use, upwards: one pass.

    Ranges of a column lie apart.  Cells are equally wide in value or in the order of all doubles; each range can be told
    apart to single doubles by a few passes of the second kind, whatever its values.
    """
    bits = max((CELLS // len(ranges)).bit_length() - 1, 8)
    own = [[(j, lo, hi) for j, (c, lo, hi) in enumerate(ranges) if c == i] for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(ranges) << bits
        weight, low, high = np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            w = batch.column(k).to_numpy(zero_copy_only=False)
            for i in range(k):
                if not own[i]:
                    continue
                number, lo, hi = (np.array(x) for x in zip(*own[i], strict=True))
                x = batch.column(i).to_numpy(zero_copy_only=False)
                j = np.maximum(np.searchsorted(lo, x, "right") - 1, 0)
                on = (x >= lo[j]) & (x <= hi[j])
                x, j, v = x[on], j[on], w[on]
                if by_value:
                    part = (x / 2 - lo[j] / 2) / (hi / 2 - lo / 2)[j] if (hi / 2 > lo / 2).all() else np.zeros(len(x))
                    cell = np.minimum((part * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                else:
                    first = _ordered(lo).view(np.uint64)
                    shift = np.array([max(int(d).bit_length() - bits, 0) for d in _ordered(hi).view(np.uint64) - first], np.uint64)
                    cell = ((_ordered(x).view(np.uint64) - first[j]) >> shift[j]).astype(np.int64)
                cell += number[j] << bits
                np.add.at(weight, cell, v)
                np.minimum.at(low, cell, x)
                np.maximum.at(high, cell, x)
        used = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used.astype(np.int32), weight[used], low[used], high[used])], names=["c", "w", "lo", "hi"])

    rows = values.select(*[f"v{i}" for i in range(k)], "w").mapInArrow(run, "c int, w double, lo double, hi double")
    got = rows.groupBy("c").agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow().sort_by("c")
    c, *rest = (x.to_numpy() for x in got.columns)
    edge = np.searchsorted(c, np.arange(len(ranges) + 1) << bits)
    return [tuple(x[a:b] for x in rest) for a, b in zip(edge, edge[1:], strict=False)]


def _narrowed(values: DataFrame, columns: list[str], probabilities: list[float], midpoints: bool) -> dict[str, list[float]]:
    """The same by histograms over shrinking ranges: each pass narrows all targets of all columns."""
    k = len(columns)
    row = values.agg(*[f(f"v{i}") for i in range(k) for f in (F.min, F.max)], *[F.coalesce(F.sum(F.when(F.col(f"v{i}").isNotNull(), F.col("w"))), F.lit(0.0)) for i in range(k)]).first()
    mass = [row[2 * k + i] for i in range(k)]
    # a target: (column, how much weight has to lie at or below the value sought)
    goal: dict[tuple[int, float], tuple[float, float, float]] = {}
    for i in range(k):
        if mass[i]:
            for p in probabilities:
                ranks = [p * mass[i]] if midpoints else [float(np.floor(p * (mass[i] - 1))) + 1, float(np.ceil(p * (mass[i] - 1))) + 1]
                for r in ranks:
                    goal[i, r] = (row[2 * i], row[2 * i + 1], 0.0)  # lowest, highest, weight below
    by_value = True
    while open_ := [t for t in goal if goal[t][0] < goal[t][1]]:
        ranges = sorted({(t[0], *goal[t][:2]) for t in open_})
        found = _histograms(values, k, ranges, by_value)
        for t in open_:
            weight, lows, highs = found[ranges.index((t[0], *goal[t][:2]))]
            upto = goal[t][2] + np.cumsum(weight)
            n = min(int(np.searchsorted(upto, t[1] * (1 - 1e-12))), len(upto) - 1)
            goal[t] = (float(lows[n]), float(highs[n]), float(upto[n] - weight[n]))
        by_value = not by_value
    at = {t: g[0] for t, g in goal.items()}
    if not midpoints:
        out = {}
        for i, c in enumerate(columns):
            x = [(p * (mass[i] - 1)) for p in probabilities] if mass[i] else []
            out[c] = [float(at[i, float(np.floor(z)) + 1] + (z - np.floor(z)) * (at[i, float(np.ceil(z)) + 1] - at[i, float(np.floor(z)) + 1])) for z in x]
        return out
    return _between_midpoints(values, columns, probabilities, mass, {t: (g[0], g[2]) for t, g in goal.items()})


def _between_midpoints(values: DataFrame, columns: list[str], probabilities: list[float], mass: list[float], at: dict[tuple[int, float], tuple[float, float]]) -> dict[str, list[float]]:
    """Interpolates between the midpoints of the value where each target's weight is reached and of its neighbours."""
    targets = list(at)
    if not targets:
        return {c: [] for c in columns}
    near = []
    for i, r in targets:
        v, x = F.col(f"v{i}"), at[i, r][0]
        near += [F.max(F.when(v < x, v)), F.sum(F.when(v == x, F.col("w"))), F.min(F.when(v > x, v)), F.sum(F.when(v < x, F.col("w")))]
    row = values.agg(*near).first()
    beside = values.agg(*[F.sum(F.when(F.col(f"v{i}") == F.lit(row[4 * j + side]), F.col("w"))) for j, (i, _) in enumerate(targets) for side in (0, 2)]).first()
    out: dict[str, list[float]] = {c: [] for c in columns}
    for i, c in enumerate(columns):
        for p in probabilities if mass[i] else []:
            j = targets.index((i, p * mass[i]))
            low, w, high, below = row[4 * j : 4 * j + 4]
            below, x = below or 0.0, at[targets[j]][0]
            points = [((below - beside[2 * j] / 2), low)] if low is not None else []
            points += [(below + w / 2, x)] + ([(below + w + beside[2 * j + 1] / 2, high)] if high is not None else [])
            out[c].append(float(np.interp(p * mass[i], [m for m, _ in points], [v for _, v in points])))
    return out


def weighted_quantiles(df: DataFrame, column: str, weight: str, probabilities: list[float]) -> list[float]:
    """:func:`exact_quantiles` of one column with checked weights; all-equal-one weights are the same as none."""
    check_weights(df, weight)
    return exact_quantiles(df, [column], probabilities, weight)[column]


def check_weights(df: DataFrame, weight: str) -> bool:
    """Raises unless weights are finite, not negative and not all 0; whether they are all 1."""
    w = F.col(quoted(weight)).cast("double")
    r = df.agg(F.count_if(~finite(w) | (w < 0)).alias("bad"), F.max(w).alias("top"), F.min(w).alias("low")).first()
    if r["bad"] or not r["top"]:
        raise ValidationError("weights must be finite and not negative, and some must be above 0")
    return r["top"] == r["low"] == 1


def few_values(df: DataFrame, columns: list[str], most: int) -> dict[str, list[float]]:
    """The sorted finite values of those columns that have at most ``most`` different ones."""
    own = df.select(*[F.when(finite(F.col(quoted(c)).cast("double")), F.col(quoted(c)).cast("double")) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0)] * len(columns)
        for batch in batches:
            for i, known in enumerate(found):
                if len(known) <= most:  # one more than that settles it
                    x = batch.column(i).drop_null().to_numpy() + 0.0
                    found[i] = np.union1d(known, x)[: most + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(columns), dtype=np.int32), [len(x) for x in found])), pa.array(np.concatenate([*found, np.zeros(0)]))], names=["c", "v"])

    got = own.mapInArrow(run, "c int, v double").distinct().toArrow()
    number, value = (x.to_numpy() for x in got.columns)
    sets = {c: np.sort(value[number == i]).tolist() for i, c in enumerate(columns)}
    return {c: v for c, v in sets.items() if len(v) <= most}


def nested_thresholds(df: DataFrame, columns: list[str], levels: tuple[int, ...] = (4, 8, 16), digits: int | None = None, weight: str | None = None) -> dict[str, dict[int, list[float]]]:
    """Thresholds for each column and level: midpoints where there are few values, else quantiles inside the range.

    A fixed number of aggregates over the table, whatever the number of columns.  Rows of weight 0 have no part.
    """
    if weight:
        df = df.where(F.col(quoted(weight)) > 0)
    few = few_values(df, columns, max(levels)) if columns else {}
    probabilities = sorted({i / b for b in levels for i in range(b + 1)})
    quantile = exact_quantiles(df, columns, probabilities, weight) if columns else {}
    out: dict[str, dict[int, list[float]]] = {}
    for c in columns:
        out[c] = {}
        for b in levels:
            if c in few and len(few[c]) <= b:
                cuts = [(x + y) / 2 for x, y in zip(few[c], few[c][1:], strict=False)]
            else:
                q = dict(zip(probabilities, quantile[c], strict=False))
                cuts = sorted({t for i in range(1, b) if (t := q.get(i / b)) is not None and q[0.0] < t < q[1.0]})
            out[c][b] = sorted({round(t, digits) for t in cuts}) if digits is not None else cuts
    return out


def newton_thresholds(cells: list[tuple[float, float, float]], levels: tuple[int, ...] = (4, 8, 16), l2: float = 5.0, least_hessian: float = 1.0) -> dict[int, list[float]]:
    """Merges neighbouring cells (lower edge, G, H) where that costs least Newton gain; snapshots at each level.

    A side with too little H is merged first.
    """
    runs = [list(c) for c in sorted(cells)]
    gain = lambda g, h: g * g / (h + l2) / 2
    out: dict[int, list[float]] = {}
    for level in sorted(levels, reverse=True):
        while len(runs) > level:
            costs = [
                gain(a[1], a[2]) + gain(b[1], b[2]) - gain(a[1] + b[1], a[2] + b[2]) - (1e6 if min(a[2], b[2]) < least_hessian else 0.0)
                for a, b in zip(runs, runs[1:], strict=False)
            ]
            i = int(np.argmin(costs))
            runs[i] = [runs[i][0], runs[i][1] + runs[i + 1][1], runs[i][2] + runs[i + 1][2]]
            del runs[i + 1]
        out[level] = [r[0] for r in runs[1:]]
    return out


def newton_cells(df: DataFrame, column: str, g: Column, h: Column, prebins: int = 64) -> list[tuple[float, float, float]]:
    """Lower edge, G and H of each of at most ``prebins`` quantile cells."""
    from ..functions import state

    cuts = nested_thresholds(df, [column], (prebins,))[column][prebins]
    rows = df.select(state(F.col(quoted(column)).cast("double"), cuts).alias("s"), g.alias("g"), h.alias("h")).groupBy("s").agg(F.sum("g"), F.sum("h")).collect()
    return [([float("-inf"), *cuts][s], gg, hh) for s, gg, hh in rows]
