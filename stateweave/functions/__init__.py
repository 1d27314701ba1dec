"""Column expressions: states, codes, lookups and links.  All stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(terms: list[Column], zero: float | int = 0) -> Column:
    return reduce(add, terms) if terms else F.lit(zero)


def state(x: Column, thresholds: list[float]) -> Column:
    """How many thresholds are at most ``x``; NaN and null get the last state."""
    if not thresholds:
        return F.lit(0)
    inside = total([(x >= F.lit(float(t))).cast("int") for t in thresholds])
    return F.when(x.isNull() | F.isnan(x), F.lit(len(thresholds))).otherwise(inside)


def direct_state(x: Column, cardinality: int, invalid: int | None = None) -> Column:
    """A number that is a state already: rounded half to even; outside 0..cardinality-1 it is ``invalid`` (None: null)."""
    r = F.rint(x)
    ok = x.isNotNull() & (F.abs(r - x) < 1e-9) & (r >= 0) & (r < cardinality)
    return F.when(ok, r.cast("int")).otherwise(F.lit(invalid).cast("int"))


def coarser(fine: Column, cardinality: int, level: int, nominal: bool = False) -> Column:
    """The state at a coarser level: neighbours merge; nominal states are never merged but collapse to 0."""
    if nominal:
        return fine if cardinality <= level else F.lit(0)
    top = min(level, cardinality)
    return F.least(F.floor(fine * F.lit(top) / F.lit(cardinality)), F.lit(top - 1)).cast("int")


def coarse_map(cardinality: int, level: int, nominal: bool = False) -> list[int]:
    """:func:`coarser` as a table."""
    if nominal:
        return list(range(cardinality)) if cardinality <= level else [0] * cardinality
    top = min(level, cardinality)
    return [min(s * top // cardinality, top - 1) for s in range(cardinality)]


def pair_code(left: Column, right: Column, right_cardinality: int) -> Column:
    return left * F.lit(right_cardinality) + right


def lookup(index: Column, table: list[float]) -> Column:
    """``table[index]``; 0 outside the table."""
    if not table:
        return F.lit(0.0)
    values = F.array(*[F.lit(float(v)) for v in table])
    return F.when((index >= 0) & (index < len(table)), F.element_at(values, index.cast("int") + 1)).otherwise(F.lit(0.0))


def residual_map(parent: list[int]) -> list[int]:
    """Relabels child states so that the first child of each parent is 0 and the others count on, parent by parent."""
    out, seen, nxt = [0] * len(parent), set(), 1
    for child in sorted(range(len(parent)), key=lambda c: (parent[c], c)):
        if parent[child] in seen:
            out[child], nxt = nxt, nxt + 1
        seen.add(parent[child])
    return out


def product_parent(left: list[int], right: list[int]) -> list[int]:
    """The parent of each joint child state, from the two single parents."""
    width = max(right) + 1
    return [a * width + b for a in left for b in right]


def nested_codes(features: dict[str, tuple[str, int]], pairs: list[tuple[str, str]] = (), levels: tuple[int, ...] = (4, 8, 16), fine_pairs: bool = False) -> dict[str, Column]:
    """Codes of nested levels: ``name_4`` is the coarse state, ``name_8`` the residual code of the next level, and so on.

    ``features``: name to (column of the finest state, its number of states).  Pairs get joint codes (``a_x_b_4``) and
    residual codes up to the level before the last, with ``fine_pairs`` up to the last.  A residual code is 0 for the
    first child of each parent, so the codes of all levels together tell the finest state and none repeats another.
    """
    out: dict[str, Column] = {}
    state_of = {(n, b): coarser(F.col(c), k, b) if k > b else F.col(c) for n, (c, k) in features.items() for b in levels}
    size = {(n, b): min(b, k) for n, (_, k) in features.items() for b in levels}
    parent = {(n, b): [next(coarse_map(k, a)[s] for s in range(k) if coarse_map(k, b)[s] == t) for t in range(min(b, k))] for n, (_, k) in features.items() for a, b in zip(levels, levels[1:], strict=False)}
    for n in features:
        out[f"{n}_{levels[0]}"] = state_of[n, levels[0]]
        for b in levels[1:]:
            out[f"{n}_{b}"] = lookup(state_of[n, b], residual_map(parent[n, b])).cast("int")
    for x, y in pairs:
        out[f"{x}_x_{y}_{levels[0]}"] = pair_code(state_of[x, levels[0]], state_of[y, levels[0]], size[y, levels[0]])
        for a, b in zip(levels, levels[1:], strict=False):
            if b == levels[-1] and not fine_pairs:
                break
            width = size[y, a]
            joint = [p * width + q for p in parent[x, b] for q in parent[y, b]]
            out[f"{x}_x_{y}_{b}"] = lookup(pair_code(state_of[x, b], state_of[y, b], size[y, b]), residual_map(joint)).cast("int")
    return out


def sigmoid(x: Column, limit: float = 50.0) -> Column:
    z = F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))
    return 1.0 / (1.0 + F.exp(-z))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(F.lit(0.0), x) + F.log1p(F.exp(-F.abs(x)))


def softmax(scores: Column, floor: float = -50.0) -> Column:
    """Of an array of doubles; shifted by the largest and clipped below."""
    shifted = F.transform(scores, lambda v: F.exp(F.greatest(v - F.array_max(scores), F.lit(floor))))
    return F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def running_max(columns: list[Column]) -> list[Column]:
    """Each column raised to the largest before it (quantiles that don't cross)."""
    out: list[Column] = []
    for c in columns:
        out.append(F.greatest(out[-1], c) if out else c)
    return out


def survival_mean(lower: float, thresholds: list[float], upper: float, survival: list[Column]) -> Column:
    """Mean from survival probabilities at thresholds, by trapezoids; 1 at ``lower`` and 0 at ``upper``."""
    edge, curve = [lower, *thresholds, upper], [F.lit(1.0), *survival, F.lit(0.0)]
    return F.lit(float(lower)) + total([F.lit((b - a) / 2) * (s + t) for a, b, s, t in zip(edge, edge[1:], curve, curve[1:], strict=False)])


def quantise(table: list[float], bits: int = 16) -> tuple[list[int], float, float]:
    """Integers, scale and largest error of a table in symmetric fixed point."""
    top = max((abs(v) for v in table), default=0.0)
    scale = top / (2 ** (bits - 1) - 1) if top else 1.0
    q = np.rint(np.array(table) / scale).astype(int)
    return q.tolist(), scale, float(np.abs(q * scale - np.array(table)).max()) if table else 0.0
