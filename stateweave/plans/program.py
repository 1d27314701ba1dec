"""A fitted model as data: how raw columns become states, tables for single states and pairs, and a link.

A program is small, plain JSON.  It is evaluated as one projection of Catalyst expressions, so it works on batch and
streaming DataFrames alike and reads only the columns that it uses.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import FeatureMeta, finite, physical, quoted


#: What a missing category is called where it is a key of its own.
MISSING_KEY = "<missing>"


@dataclass
class Feature:
    """How a raw column becomes a state.

    numeric: median and thresholds; missing: the flag; category: sorted values, the last state (if reserved) for the
    rest; category_bit: one binary digit of that state; ordered: scores of values, their default, and thresholds;
    embedding: two centroids and thresholds on the difference of distances; projection: a mean and a direction;
    prototype: scales, centres of both classes in scaled components (``shape``: how many of each) and thresholds on the
    difference of distances.
    """

    name: str
    kind: str
    column: str
    cardinality: int
    median: float = 0.0
    thresholds: list[float] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    default: float = 0.0
    bit: int = 0
    reserved: bool = True
    shape: list[int] = field(default_factory=list)

    @property
    def state_column(self) -> str:
        return "s_" + physical(self.name)

    @property
    def meta(self) -> FeatureMeta:
        return FeatureMeta(self.name, self.state_column, self.kind, self.cardinality)

    def _code(self, x: Column) -> Column:
        if not self.values:
            return F.lit(0)
        table = F.create_map(*[F.lit(v) for i, value in enumerate(self.values) for v in (value, i)])
        return F.coalesce(F.element_at(table, x.cast("string")), F.lit(len(self.values) if self.reserved else 0))

    def expression(self) -> Column:
        x = F.col(quoted(self.column))
        if self.kind == "missing":
            return (~F.coalesce(finite(x.cast("double")), F.lit(False))).cast("int")
        if self.kind == "numeric":
            d = x.cast("double")
            return fn.state(F.when(finite(d), d).otherwise(F.lit(self.median)), self.thresholds)
        if self.kind == "category":
            return self._code(x)
        if self.kind == "category_bit":
            return F.shiftright(self._code(x), self.bit).bitwiseAND(F.lit(1)).cast("int")
        if self.kind == "ordered":
            table = F.create_map(*[F.lit(v) for value, s in zip(self.values, self.scores, strict=True) for v in (value, s)]) if self.values else None
            key = x.cast("string") if self.reserved else F.coalesce(x.cast("string"), F.lit(MISSING_KEY))
            score = F.coalesce(F.element_at(table, key), F.lit(self.default)) if table is not None else F.lit(self.default)
            s = fn.state(F.round(score, 9), self.thresholds) + 1
            return F.when(x.isNull(), F.lit(0)).otherwise(s) if self.reserved else s
        if self.kind == "embedding":
            half = len(self.scores) // 2
            from ..operators.adapt import centroid_direction

            return fn.state(centroid_direction(None, self.column, {0: self.scores[:half], 1: self.scores[half:]}), self.thresholds)
        if self.kind in ("projection", "prototype"):
            return fn.state(F.round(self.direction(), 9), self.thresholds)
        raise ValueError(self.kind)

    def direction(self) -> Column:
        """The number whose quantiles a projection's or prototype's states are."""
        from ..operators import adapt

        if self.kind == "projection":
            half = len(self.scores) // 2
            return adapt.projected(self.column, np.array(self.scores[:half]), np.array([self.scores[half:]]))[0]
        parts = np.array(self.scores).reshape(sum(self.shape) + 1, -1)
        scale, centres = parts[0], parts[1:] * parts[0]
        return adapt.prototype_score(self.column, {0: centres[: self.shape[0]], 1: centres[self.shape[0] :]}, scale)


@dataclass
class Program:
    """score = intercept + tables of single states, pairs and triples + linear terms; then the link."""

    features: dict[str, Feature]
    intercept: float = 0.0
    unary: list[tuple[str, list[float]]] = field(default_factory=list)
    pairs: list[tuple[str, str, list[list[float]]]] = field(default_factory=list)
    linear: list[tuple[str, float, float, float, float]] = field(default_factory=list)  # column, median, mean, scale, coefficient
    link: str = "identity"
    scale: float = 1.0
    bits: int | None = None
    cubes: list[tuple[str, str, str, list[float]]] = field(default_factory=list)  # by joint state, the last feature counting fastest
    sparse: list[tuple[str, str, list[int], list[list[float]]]] = field(default_factory=list)  # which row each state of the first feature reads; the rows

    @property
    def used(self) -> set[str]:
        """Names of the features that some table reads."""
        return {f for f, _ in self.unary} | {f for a, b, *_ in [*self.pairs, *self.sparse] for f in (a, b)} | {f for *c, _ in self.cubes for f in c}

    @property
    def tables(self) -> list[list[float]]:
        """The stored numbers of every table, one flat list each."""
        return [t for _, t in self.unary] + [[v for r in t for v in r] for *_, t in [*self.pairs, *self.sparse]] + [t for *_, t in self.cubes]

    @property
    def inputs(self) -> list[str]:
        """Raw columns that the program reads."""
        used = self.used
        return list(dict.fromkeys([*(self.features[f].column for f in self.features if f in used), *(c for c, *_ in self.linear)]))

    def score(self, states: dict[str, Column] | None = None) -> Column:
        s = states or {n: f.expression() for n, f in self.features.items()}
        terms = [self._table(s[f], t) for f, t in self.unary]
        for a, b, t in self.pairs:
            width = self.features[b].cardinality
            inside = (s[a] >= 0) & (s[a] < len(t)) & (s[b] >= 0) & (s[b] < width)
            terms.append(F.when(inside, self._table(fn.pair_code(s[a], s[b], width), [v for row in t for v in row])).otherwise(F.lit(0.0)))
        for a, b, slots, t in self.sparse:
            width = len(t[0])
            inside = (s[a] >= 0) & (s[a] < len(slots)) & (s[b] >= 0) & (s[b] < width)
            row = F.element_at(F.array(*map(F.lit, slots)), s[a].cast("int") + 1)
            terms.append(F.when(inside, self._table(fn.pair_code(row, s[b], width), [v for r in t for v in r])).otherwise(F.lit(0.0)))
        for a, b, c, t in self.cubes:
            kb, kc = self.features[b].cardinality, self.features[c].cardinality
            terms.append(self._table((s[a] * kb + s[b]) * kc + s[c], t))
        for c, median, mean, scale, w in self.linear:
            x = F.col(quoted(c)).cast("double")
            terms.append((F.when(finite(x), x).otherwise(F.lit(median)) - mean) / scale * w)
        return F.lit(float(self.intercept)) + fn.total(terms, 0.0)

    def _table(self, index: Column, table: list[float]) -> Column:
        if self.bits is None:
            return fn.lookup(index, table)
        if self.bits == 32:
            return fn.lookup(index, np.float32(table).astype(float).tolist())
        q, scale, _ = fn.quantise(table, self.bits)
        return fn.lookup(index, [float(v) for v in q]) * F.lit(scale)

    def value(self, score: Column | None = None, offset: Column | None = None, exposure: Column | None = None) -> Column:
        z = self.score() if score is None else score
        if offset is not None:
            z = z + offset
        if self.link == "logit":
            return fn.sigmoid(z)
        if self.link == "log":
            out = F.exp(F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))) * F.lit(self.scale)
            return out * exposure if exposure is not None else out
        return z

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with the linked value; states are computed once, in a projection below."""
        used = [f for f in self.features if f in self.used]
        tag = {f: f"__{i}_{self.features[f].state_column}" for i, f in enumerate(used)}
        below = df.select("*", *[self.features[f].expression().alias(tag[f]) for f in used])
        return below.withColumn(output, self.value(self.score({f: F.col(tag[f]) for f in used}))).drop(*tag.values())

    def error_bound(self) -> float:
        """Largest error of the score that quantised tables can cause (a probability's is a quarter of it)."""
        if self.bits is None:
            return 0.0
        if self.bits == 32:
            return sum(float(np.abs(np.float32(t).astype(float) - np.array(t)).max(initial=0)) for t in self.tables)
        return sum(fn.quantise(t, self.bits)[2] for t in self.tables)

    def size_bytes(self) -> int:
        """Bytes of tables and thresholds, and of the bookkeeping of features and pairs."""
        cell = 8 if self.bits is None else self.bits // 8
        slots = sum(len(slots) * slot_bytes(t) for _, _, slots, t in self.sparse)
        return cell * sum(map(len, self.tables)) + slots + sum(8 * len(f.thresholds) for f in self.features.values()) + 2 * len(self.features) + 4 * (len(self.pairs) + len(self.sparse))

    def dense(self) -> Program:
        """The same program with every table of pairs written out."""
        return replace(self, pairs=[*self.pairs, *[(a, b, [list(t[i]) for i in slots]) for a, b, slots, t in self.sparse]], sparse=[])

    def quantised(self, bits: int = 16) -> Program:
        """Tables in fixed point of 8 or 16 bits, or in single precision (32)."""
        return replace(self, bits=bits)

    def calibrated(self, scale: float, offset: float) -> Program:
        """Scale and offset folded into the tables: no extra work at prediction."""
        return replace(
            self,
            intercept=self.intercept * scale + offset,
            unary=[(f, [v * scale for v in t]) for f, t in self.unary],
            pairs=[(a, b, [[v * scale for v in r] for r in t]) for a, b, t in self.pairs],
            linear=[(c, md, m, s, w * scale) for c, md, m, s, w in self.linear],
            cubes=[(a, b, c, [v * scale for v in t]) for a, b, c, t in self.cubes],
            sparse=[(a, b, slots, [[v * scale for v in r] for r in t]) for a, b, slots, t in self.sparse],
        )

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(d: dict) -> Program:
        d = dict(d)
        d["features"] = {k: Feature(**v) for k, v in d["features"].items()}
        for k in ("unary", "pairs", "linear", "cubes", "sparse"):
            d[k] = [tuple(x) for x in d.get(k, [])]
        return Program(**d)


@dataclass
class Bundle:
    """Several heads: ``softmax`` over classes, ``normalise`` (one against the rest), or a threshold for each label."""

    heads: list[Program]
    coupling: str
    classes: list = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def scores(self) -> Column:
        return F.array(*[h.score() for h in self.heads])

    def probabilities(self, scores: Column | None = None) -> Column:
        scores = self.scores() if scores is None else scores
        if self.coupling == "softmax":
            return fn.softmax(scores)
        each = F.transform(scores, lambda v: fn.sigmoid(v))
        if self.coupling == "normalise":
            return F.transform(each, lambda v: v / F.aggregate(each, F.lit(0.0), lambda a, b: a + b))
        return each

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        shared = {n: f for h in self.heads for n, f in h.features.items()}
        names = {n: f"__b{i}" for i, n in enumerate(shared)}
        alike = all(h.features[n] == shared[n] for h in self.heads for n in h.features)
        if alike:  # heads with one encoding: states are computed once
            df = df.select("*", *[f.expression().alias(names[n]) for n, f in shared.items()])
        z = [h.score({n: F.col(names[n]) for n in h.features}) if alike and h.features else h.score() for h in self.heads]
        out = df.withColumn("__z", F.array(*z)).withColumn("probabilities", self.probabilities(F.col("__z"))).drop("__z", *names.values())
        if self.coupling == "labels":
            cuts = F.array(*map(F.lit, self.thresholds))
            return out.withColumn(output, F.zip_with("probabilities", cuts, lambda p, t: (p >= t).cast("int")))
        return out.withColumn(output, F.element_at(F.array(*map(F.lit, self.classes)), fn.argmax(F.col("probabilities")) + 1))

    def to_json(self) -> dict:
        return {"heads": [h.to_json() for h in self.heads], "coupling": self.coupling, "classes": self.classes, "thresholds": self.thresholds}

    @staticmethod
    def from_json(d: dict) -> Bundle:
        return Bundle([Program.from_json(h) for h in d["heads"]], d["coupling"], d["classes"], d["thresholds"])


@dataclass
class SharedProgram:
    """Several outputs on one set of features: every table holds a row of all outputs' values for each state.

    A state is looked up once for all outputs; the rows are added up.  ``link``: "softmax", "logit" or "identity".
    """

    features: dict[str, Feature]
    intercept: list[float]
    unary: list[tuple[str, list[list[float]]]] = field(default_factory=list)
    pairs: list[tuple[str, str, list[list[float]]]] = field(default_factory=list)  # by joint state, the second counting fastest
    link: str = "softmax"
    outputs: list = field(default_factory=list)

    @staticmethod
    def of(bundle: Bundle) -> SharedProgram:
        """The heads of a bundle, which must read their features alike and have no other terms, as one program."""
        features: dict[str, Feature] = {}
        for h in bundle.heads:
            if h.linear or h.cubes or h.bits or any(features.get(n, f) != f for n, f in h.features.items()):
                raise ValueError("heads with features of their own or with other terms can't share tables")
            features |= h.features
        size = len(bundle.heads)
        single: dict[str, np.ndarray] = {}
        joint: dict[tuple[str, str], np.ndarray] = {}
        for k, h in enumerate(map(Program.dense, bundle.heads)):
            for f, t in h.unary:
                single.setdefault(f, np.zeros((features[f].cardinality, size)))[: len(t), k] += t
            for a, b, t in h.pairs:
                table = joint.setdefault((a, b), np.zeros((features[a].cardinality, features[b].cardinality, size)))
                table[: len(t), : len(t[0]), k] += np.array(t)
        link = "softmax" if bundle.coupling == "softmax" else "logit"
        return SharedProgram(features, [h.intercept for h in bundle.heads], [(f, t.tolist()) for f, t in single.items()], [(a, b, t.reshape(-1, size).tolist()) for (a, b), t in joint.items()], link, list(bundle.classes))

    def scores(self) -> Column:
        """An array with each output's score."""
        s = {n: f.expression() for n, f in self.features.items()}
        add = lambda total, index, table: F.zip_with(total, F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in table]), index.cast("int") + 1), lambda a, b: a + b)
        total = F.array(*[F.lit(float(v)) for v in self.intercept])
        for f, t in self.unary:
            total = add(total, s[f], t)
        for a, b, t in self.pairs:
            total = add(total, fn.pair_code(s[a], s[b], self.features[b].cardinality), t)
        return total

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with an array of linked values."""
        z = self.scores()
        value = fn.softmax(F.col("__z")) if self.link == "softmax" else F.transform("__z", fn.sigmoid) if self.link == "logit" else F.col("__z")
        return df.withColumn("__z", z).withColumn(output, value).drop("__z")

    def size_bytes(self) -> int:
        """Bytes of tables and thresholds."""
        return 8 * sum(len(t) * len(self.intercept) for *_, t in [*self.unary, *self.pairs]) + sum(8 * len(f.thresholds) for f in self.features.values())


def slot_bytes(rows: list) -> int:
    """Bytes of a number that says which of some rows is meant."""
    return 1 if len(rows) <= 256 else 2 if len(rows) <= 65_536 else 4


def constant_program(share: float, limit: float = 1e-6) -> Program:
    """A head for a label that never changes: its clipped log odds."""
    from math import log

    p = min(max(share, limit), 1 - limit)
    return Program({}, log(p / (1 - p)), link="logit")


def max_error(a: Program, b: Program, df: DataFrame) -> DataFrame:
    """what, largest_error, n: the largest differences of two programs' scores and probabilities on a table (one pass)."""
    x, y = a.score(), b.score()
    row = df.select(F.abs(x - y).alias("z"), F.abs(fn.sigmoid(x) - fn.sigmoid(y)).alias("p")).agg(F.max("z").alias("z"), F.max("p").alias("p"), F.count("*").alias("n"))
    each = F.array(F.struct(F.lit("score").alias("what"), F.col("z").alias("largest_error"), "n"), F.struct(F.lit("probability").alias("what"), F.col("p").alias("largest_error"), "n"))
    return row.select(F.explode(each).alias("e")).select("e.*")
