"""Linear designs over finite states, and what fits sum over rows of them.

A term of a design reads a finite code of a row (a state, a joint state of a pair, a state inside a gate) and has a table
with a row of column values for each code.  Gradients and Hessians are therefore sums by code and by pairs of codes,
projected by the tables afterwards: no matrix with a row for each row of the data is ever made.  The codes of a batch
are read once for all designs that are solved together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import quoted
from ..sources.interim import stored

#: Rows (as they are, or grouped by what a design reads) that the driver takes over.
DRIVER_ROWS = 200_000
#: Rows that stay distributed are grouped once if each different one occurs so often on average.
REPEATS = 4
#: Rows of these that are worked on together.
CHUNK_ROWS = 50_000


@dataclass(frozen=True)
class Term:
    """A finite code of a row: of one state column, of two (jointly), or of the second where the first is in state ``gate``.

    Codes outside the table count as code 0.
    """

    columns: tuple[str, ...]
    sizes: tuple[int, ...]
    gate: int | None = None

    @property
    def codes(self) -> int:
        return self.sizes[-1] + 1 if self.gate is not None else int(np.prod(self.sizes))

    def code(self, data: dict[str, np.ndarray]) -> np.ndarray:
        if self.gate is not None:
            own = np.minimum(data[self.columns[1]].astype(np.int64), self.sizes[-1] - 1) + 1
            return np.where(data[self.columns[0]] == self.gate, own, 0)
        out = np.zeros(len(data[self.columns[0]]), np.int64)
        for c, k in zip(self.columns, self.sizes, strict=True):
            out = out * k + data[c].astype(np.int64)
        return np.where((out >= 0) & (out < self.codes), out, 0)


@dataclass
class Design:
    """Columns of a linear model.

    mains: (state column, cardinality), state 0 being the reference; pairs: (column, cardinality, column, cardinality),
    joint code 0 being the reference; linear: (column, mean, scale); blocks: (gate column, gate state, target column,
    centres, scales).  A constant comes first.  ``shapes``: for some mains (by state column) and pairs (by both), a table
    with the columns' values for each code, instead of a column for each code but 0.
    """

    mains: list[tuple[str, int]] = field(default_factory=list)
    pairs: list[tuple[str, int, str, int]] = field(default_factory=list)
    linear: list[tuple[str, float, float]] = field(default_factory=list)
    blocks: list[tuple[str, int, str, list[float], list[float]]] = field(default_factory=list)
    shapes: dict = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        names = [c for c, _ in self.mains] + [c for p in self.pairs for c in (p[0], p[2])] + [c for c, *_ in self.linear] + [c for b in self.blocks for c in (b[0], b[2])]
        return list(dict.fromkeys(names))

    @cached_property
    def terms(self) -> list[tuple[Term, np.ndarray | None]]:
        """Mains, pairs and blocks, each with its table (None: a column for each code but 0)."""
        out = [(Term((c,), (k,)), self.shapes.get(c)) for c, k in self.mains]
        out += [(Term((a, b), (ka, kb)), self.shapes.get((a, b))) for a, ka, b, kb in self.pairs]
        for gate, s, target, centres, scales in self.blocks:
            k = len(centres)
            out.append((Term((gate, target), (0, k + 1), s), np.vstack([np.zeros(k), (np.eye(k + 1)[:, :k] - centres) * scales])))
        return out

    @property
    def widths(self) -> list[int]:
        """Of the constant, mains, pairs, linear terms and blocks."""
        width = [t.codes - 1 if table is None else table.shape[1] for t, table in self.terms]
        n = len(self.mains) + len(self.pairs)
        return [1, *width[:n], *(1 for _ in self.linear), *width[n:]]

    @property
    def width(self) -> int:
        return sum(self.widths)

    def split(self, w: np.ndarray) -> list[np.ndarray]:
        """Coefficients term by term."""
        return np.split(w, np.cumsum(self.widths)[:-1])

    def lookups(self, w: np.ndarray) -> list[np.ndarray]:
        """For each main effect, then each pair: what its coefficients add to the score, by code."""
        return [_effect(table, p) for (_, table), p in zip(self.terms, self.split(w)[1 : 1 + len(self.mains) + len(self.pairs)], strict=False)]


def _effect(table: np.ndarray | None, w: np.ndarray) -> np.ndarray:
    return np.append(0.0, w) if table is None else table @ w


def _project(table: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Sums by code (along the first axis) to sums by column."""
    return x[1:] if table is None else table.T @ x


class Batch:
    """Rows of some designs: their codes, linear columns, and the data itself."""

    def __init__(self, data: dict[str, np.ndarray], n: int, terms: list[Term], linear: list[tuple[str, float, float]]):
        self.data, self.n = data, n
        self.code = {t: t.code(data) for t in terms}
        self.z = {x: (data[x[0]] - x[1]) / x[2] for x in linear}

    def __getitem__(self, column: str) -> np.ndarray:
        return self.data[column]


class Cells:
    """The sums of one design: taken by code over batches (``raw_``), then projected to its columns."""

    def __init__(self, design: Design):
        self.design, self.terms = design, design.terms
        edge, n, lin = np.cumsum([0, *design.widths]), len(design.mains) + len(design.pairs), len(design.linear)
        self.p = int(edge[-1])
        self.numbers = [0, *range(edge[1 + n], edge[1 + n + lin])]
        spans = [slice(a, b) for a, b in zip(edge, edge[1:], strict=False)]
        self.at = spans[1 : 1 + n] + spans[1 + n + lin :]
        self.size = len(self.numbers) + sum(t.codes for t, _ in self.terms)
        k = [t.codes for t, _ in self.terms]
        self.square_size = len(self.numbers) ** 2 + len(self.numbers) * sum(k) + sum(k[i] * k[j] for i in range(len(k)) for j in range(i))

    def score(self, batch: Batch, w: np.ndarray) -> np.ndarray:
        out = np.full(batch.n, w[0])
        for x, at in zip(self.design.linear, self.numbers[1:], strict=True):
            out += batch.z[x] * w[at]
        for (t, table), at in zip(self.terms, self.at, strict=True):
            out += _effect(table, w[at])[batch.code[t]]
        return out

    def raw_sums(self, batch: Batch, r: np.ndarray) -> np.ndarray:
        """Sums of ``r``, of its products with linear columns, and of ``r`` by each term's code."""
        return np.concatenate([[r.sum()], [batch.z[x] @ r for x in self.design.linear], *[np.bincount(batch.code[t], r, t.codes) for t, _ in self.terms]])

    def sums(self, raw: np.ndarray) -> np.ndarray:
        """X'r."""
        out, at = np.zeros(self.p), len(self.numbers)
        out[self.numbers] = raw[:at]
        for (t, table), own in zip(self.terms, self.at, strict=True):
            out[own] = _project(table, raw[at : at + t.codes])
            at += t.codes
        return out

    def raw_square(self, batch: Batch, d: np.ndarray) -> np.ndarray:
        """Sums of ``d`` by pairs of codes, and with linear columns: a joint histogram for each two terms."""
        z = np.stack([np.ones(batch.n), *[batch.z[x] for x in self.design.linear]])
        out = [((z * d) @ z.T).ravel()]
        for i, (t, _) in enumerate(self.terms):
            code = batch.code[t]
            out += [np.bincount(code, d * row, t.codes) for row in z]
            out += [np.bincount(batch.code[u] * t.codes + code, d, u.codes * t.codes) for u, _ in self.terms[:i]]
        return np.concatenate(out)

    def square(self, raw: np.ndarray) -> np.ndarray:
        """X'DX."""
        h, m = np.zeros((self.p, self.p)), len(self.numbers)
        h[np.ix_(self.numbers, self.numbers)] = raw[: m * m].reshape(m, m)
        at = m * m
        for i, ((t, table), own) in enumerate(zip(self.terms, self.at, strict=True)):
            with_numbers = raw[at : at + m * t.codes].reshape(m, t.codes)
            at += m * t.codes
            for row, k in zip(with_numbers, self.numbers, strict=True):
                h[own, k] = _project(table, row)
                h[k, own] = h[own, k]
            diagonal = with_numbers[0]  # with the constant: by code
            h[own, own] = np.diag(diagonal[1:]) if table is None else table.T @ (table * diagonal[:, None])
            for (u, other), theirs in zip(self.terms[:i], self.at, strict=False):
                joint = raw[at : at + u.codes * t.codes].reshape(u.codes, t.codes)
                at += u.codes * t.codes
                x = _project(table, _project(other, joint).T)
                h[own, theirs], h[theirs, own] = x, x.T
        return h


def distributed_sum(df: DataFrame, columns: list[str], work: Callable[[dict[str, np.ndarray], int], np.ndarray], size: int) -> np.ndarray:
    """Sums ``work`` (an array of ``size``) over all batches of ``df``: one entry of each partition is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += work({c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}, batch.num_rows)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], names=["i", "x"])

    out = np.zeros(size)
    got = df.select(*map(quoted, columns)).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


class Rows:
    """What a fit reads: the design's columns, targets and weights.

    Few rows are taken over by the driver as they are; many are grouped by what is read first, if an estimate of the
    number of different ones (one pass, no shuffle) says that this makes them few.  Else they stay distributed: grouped
    once and kept as a table where each occurs several times on average, as they are otherwise.
    """

    def __init__(self, df: DataFrame, columns: list[str], targets: list[str], weight: str | None = None, driver_rows: int = DRIVER_ROWS, extra: list[str] = ()):
        w = F.col(quoted(weight)).cast("double") if weight else F.lit(1.0)
        keys = list(dict.fromkeys([*columns, *targets, *extra]))
        self.columns = [*keys, "__w"]
        self.df = df.select(*map(quoted, keys), w.alias("__w")).where("__w > 0")
        self.local, taken = None, None
        n, different = self.df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*map(quoted, keys)) if keys else F.lit(0), 0.02)).first()
        if n <= driver_rows:
            taken = self.df.toArrow()
        elif different * 1.1 <= driver_rows:
            taken = self._grouped(keys).limit(driver_rows + 1).toArrow()
        elif different * REPEATS <= n:
            self.df = stored(self._grouped(keys))
        if taken is not None and taken.num_rows <= driver_rows:
            self.local = {c: taken.column(i).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(self.columns)}
            self.n = taken.num_rows

    def _grouped(self, keys: list[str]) -> DataFrame:
        return self.df.groupBy(*map(quoted, keys)).agg(F.sum("__w").alias("__w"))

    def sum(self, work: Callable[[dict[str, np.ndarray], int], np.ndarray], size: int) -> np.ndarray:
        if self.local is None:
            return distributed_sum(self.df, self.columns, work, size)
        out = np.zeros(size)
        for a in range(0, self.n, CHUNK_ROWS):
            part = {c: v[a : a + CHUNK_ROWS] for c, v in self.local.items()}
            out += work(part, len(part["__w"]))
        return out

    def part(self, column: str, value: int, without: bool = False) -> Rows:
        """The rows that have (``without``: don't have) a value of a column."""
        import copy

        out = copy.copy(self)
        if self.local is not None:
            on = (self.local[column] == value) != without
            out.local = {k: v[on] for k, v in self.local.items()}
            out.n = int(on.sum())
        else:
            out.df = self.df.where((F.col(column) == value) != F.lit(without))
        return out


class Bank:
    """The codes of several designs' rows, read once: on the driver for good, else once for each batch of each pass."""

    def __init__(self, rows: Rows, designs: list[Design]):
        self.rows = rows
        self.terms = list(dict.fromkeys(t for d in designs for t, _ in d.terms))
        self.linear = list(dict.fromkeys(x for d in designs for x in d.linear))
        self.batches: list[Batch] | None = None

    def sum(self, work: Callable[[Batch], np.ndarray], size: int) -> np.ndarray:
        rows, terms, linear = self.rows, self.terms, self.linear
        if rows.local is None:
            return distributed_sum(rows.df, rows.columns, lambda data, n: work(Batch(data, n, terms, linear)), size)
        if self.batches is None:
            parts = [{c: v[a : a + CHUNK_ROWS] for c, v in rows.local.items()} for a in range(0, rows.n, CHUNK_ROWS)]
            self.batches = [Batch(p, len(p["__w"]), terms, linear) for p in parts]
        out = np.zeros(size)
        for b in self.batches:
            out += work(b)
        return out
