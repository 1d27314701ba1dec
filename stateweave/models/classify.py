"""Classifiers with finite-state structure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..keys import hashed_fold
from ..operators import rank, solve, stats
from ..operators.cache import HistogramCache
from ..operators.deltas import fit_deltas, prefixes
from ..plans.program import Bundle, Program, constant_program
from ..plans.rewrite import optimised
from ..schema import ParameterError, ValidationError, quoted
from .base import Adapter, Estimator, positive_weight, weighted_mean


#: How pairs may be ranked.
PAIR_RANKINGS = ("mi", "newton", "residual_newton", "newton_prefilter_mi", "diversified")


def ranked_structure(states: DataFrame, adapter: Adapter, target: str, max_features: int, pair_features: int, max_pairs: int, how: str = "mi", key: str | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """The best single features (by information) and pairs (see ``PAIR_RANKINGS``), as feature names in order.

    "newton" ranks by gain on the residuals of a constant, "residual_newton" on those of main effects that were fitted
    on other folds of the key; "newton_prefilter_mi" takes the best by "newton", then the best of these by information;
    "diversified" takes two thirds by information and the rest by "residual_newton".
    """
    if how not in PAIR_RANKINGS:
        raise ParameterError(f"pair ranking {how!r}; there are {PAIR_RANKINGS}")
    name = {f.state_column: f.name for f in adapter.features}
    columns = list(name)
    weight = F.col(quoted(adapter.weight)).cast("double") if adapter.weight else None
    one = stats.mutual_information(stats.state_cells(states, columns, [target], weight=weight), ["feature"], ["state"], target)
    best = [r["feature"] for r in rank.top_features(one, columns, "mi", max_features).orderBy("rank").collect()]
    chosen = best[:pair_features]
    if len(chosen) < 2 or max_pairs < 1:
        return [name[c] for c in best], []
    total = len(chosen) * (len(chosen) - 1) // 2

    def by_information(k: int, pairs: DataFrame | None = None) -> DataFrame:
        two = stats.mutual_information(stats.tuple_cells(states, stats.pairs_of(chosen), [target], weight=weight), ["f0", "f1"], ["s0", "s1"], target)
        two = two.join(F.broadcast(pairs.select("f0", "f1")), ["f0", "f1"], "left_semi") if pairs is not None else two  # at most the pairs of the chosen
        return rank.top_pairs(rank.with_marginals(two, one, "mi"), columns, "excess", k, "mi")

    def by_gain(k: int, residual: bool) -> DataFrame:
        data, p = (crossfitted(states, adapter, [name[c] for c in chosen], target, key), F.col("__p")) if residual else (states, None)
        if p is None:
            w = weight if weight is not None else F.lit(1.0)
            p = F.lit(states.agg(F.sum(w * F.col(target)) / F.sum(w)).first()[0])
        made = HistogramCache.newton(data, chosen, target, p, weight)
        return rank.top_pairs(made.pair_gains([5.0]).drop("l2"), columns, "excess", k, "gain")

    if how == "mi":
        top = by_information(max_pairs)
    elif how in ("newton", "residual_newton"):
        top = by_gain(max_pairs, how != "newton")
    elif how == "newton_prefilter_mi":
        top = by_information(max_pairs, by_gain(min(total, 4 * max_pairs), False))
    else:
        pool = min(total, max(2 * max_pairs, max_pairs + 4))
        top = rank.diversified(by_information(pool), by_gain(pool, True), max_pairs)
    return [name[c] for c in best], [(name[r["f0"]], name[r["f1"]]) for r in top.orderBy("rank").collect()]


def crossfitted(states: DataFrame, adapter: Adapter, mains: list[str], target: str, key: str, folds: int = 3, c: float = 0.2) -> DataFrame:
    """``states`` with ``__p``: for each row the probability by main effects that were fitted on the other folds."""
    design = design_of(adapter, mains, [])
    data = states.withColumn("__cf", hashed_fold(F.col(quoted(key)), folds, 17))  # by other folds than calibration's
    rows = solve.Rows(data, design.columns, [target], adapter.weight, extra=["__cf"])
    named = {f.name: F.col(f.state_column) for f in adapter.features if f.name in mains}
    p = F.lit(None).cast("double")
    models = solve.newton_many(rows, [solve.Problem(design, 1.0 / c, part=("__cf", k, True)) for k in range(folds)], target, solve.logistic)
    for k, w in enumerate(models):
        p = F.when(F.col("__cf") == k, fn.sigmoid(program_of(adapter, mains, [], w, design, "logit").score(named))).otherwise(p)
    return data.withColumn("__p", p)


#: Kinds of features whose states have no order, so that coarser levels don't merge them.
NOMINAL = ("category", "category_bit", "missing")


def design_of(adapter: Adapter, mains: list[str], pairs: list[tuple[str, str]], linear: list[tuple[str, float, float]] = (), coding: str = "states", levels: tuple[int, ...] = (4, 8, 16), fine_pairs: bool = False) -> solve.Design:
    """A design of single states and joint states of pairs.

    ``coding="nested"``: a column for each coarse state but the first, and for each child state but the first of its
    parent, level by level (pairs: up to the level before the last, or with ``fine_pairs`` up to it).  It spans what
    single states span, but a penalty pulls children towards their parents.
    """
    f = adapter.by_name()
    shapes: dict = {}
    if coding == "nested":
        ways = {n: level_maps(f[n].cardinality, levels, f[n].kind in NOMINAL) for n in {*mains, *(x for p in pairs for x in p)}}
        shapes |= {f[n].state_column: nested_table(ways[n]) for n in mains}
        depth = None if fine_pairs else max(1, len(levels) - 1)
        for a, b in pairs:
            joint = [product_map(x, y) for x, y in zip(ways[a], ways[b], strict=True)]
            shapes[f[a].state_column, f[b].state_column] = nested_table(joint[:depth])
    return solve.Design([(f[n].state_column, f[n].cardinality) for n in mains], [(f[a].state_column, f[a].cardinality, f[b].state_column, f[b].cardinality) for a, b in pairs], list(linear), shapes=shapes)


def level_maps(cardinality: int, levels: tuple[int, ...], nominal: bool) -> list[list[int]]:
    """The state at each level that each finest state belongs to; the last level is the finest one itself."""
    if nominal:
        return [list(range(cardinality))] * len(levels)
    return [*(fn.coarse_map(cardinality, b) for b in levels[:-1]), list(range(cardinality))]


def product_map(left: list[int], right: list[int]) -> list[int]:
    """Joint states at a level, by joint finest state."""
    width = max(right) + 1
    return [a * width + b for a in left for b in right]


def nested_table(levels: list[list[int]]) -> np.ndarray:
    """Columns by finest state: indicators of coarse states but 0, then of child states that aren't the first of their parent."""
    first = np.array(levels[0])
    out = [first[:, None] == np.unique(first)[1:]]
    for above, below in zip(levels, levels[1:], strict=False):
        child = np.array(below)
        _, at = np.unique(child, return_index=True)  # a finest state of each child
        code = np.array(fn.residual_map([above[i] for i in at]))
        out.append(code[np.searchsorted(child[at], child)][:, None] == np.arange(1, code.max(initial=0) + 1))
    return np.column_stack(out).astype(float)


def program_of(adapter: Adapter, mains: list[str], pairs: list[tuple[str, str]], w: np.ndarray, design: solve.Design, link: str, linear: list[tuple[str, float, float, float]] = (), blocks: list[tuple[str, int, str]] = ()) -> Program:
    """Coefficients as tables; linear: (column, median, mean, scale), blocks: (gate, state, target), in the design's order.

    Nested columns are folded into one table a feature or pair; a block is a table that is zero but for one row.
    """
    f = adapter.by_name()
    parts, tables = design.split(w), design.lookups(w)
    unary = [(n, t.tolist()) for n, t in zip(mains, tables, strict=False)]
    joint = [(a, b, t.reshape(f[a].cardinality, f[b].cardinality).tolist()) for (a, b), t in zip(pairs, tables[len(mains) :], strict=True)]
    terms = [(c, md, m, s, float(p[0])) for (c, md, m, s), p in zip(linear, parts[1 + len(mains) + len(pairs) :], strict=False)]
    for (gate, s, target), own, p in zip(blocks, design.blocks, parts[1 + len(mains) + len(pairs) + len(linear) :], strict=False):
        k, effect = f[target].cardinality, np.asarray(p) * np.asarray(own[4])
        table = np.zeros((f[gate].cardinality, k))
        table[s] = np.append(effect, np.zeros(k - len(effect))) - effect @ np.asarray(own[3])
        joint.append((gate, target, table.tolist()))
    return Program(f, float(parts[0][0]), unary, joint, terms, link)


class StateClassifier(Estimator):
    """Binary or multiclass classification.

    Candidates (numbers of main effects and pairs, penalties) are compared on keys held out; of those within
    ``near_tie`` of the best log loss the smallest program wins, which is then refitted on all rows.  Multiclass: one
    head against the rest for each class, coupled by the softmax of their scores, or ``multiclass="softmax"``: one fit of
    all classes on shared structure, to which ``class_deltas`` corrections of single states may be added.

    All candidates of a head are solved in the same passes, from the strongest penalty to the weakest.
    ``coding="nested"`` (see :func:`design_of`).  ``calibration`` ("affine", "intercept"): a scale and an offset fitted
    to scores of three fold models and folded into the tables, if that gains 0.0001 and a standard error of it.
    """

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"c": (0.2, 1.0), "multiclass": "ovr", "calibration": "none", "pair_ranking": "mi", "class_deltas": 0, "coding": "states", "fine_pairs": False}

    def fit(self, df: DataFrame, features: list[str], target: str, key: str) -> StateClassifier:
        df = positive_weight(df, self.weight)
        self._start(df, features, key, 8)
        counts = {r[0]: r[1] for r in df.groupBy(quoted(target)).count().collect()}
        if None in counts or len(counts) < 2 or min(counts.values()) < 4:
            raise ValidationError(f"each class needs 4 rows, and there must be two: {counts}")
        self.classes_ = sorted(counts)
        code = F.array_position(F.array(*map(F.lit, self.classes_)), F.col(quoted(target))) - 1
        data = df.withColumn("__y", code.cast("int"))
        self.diagnostics_: list[dict] = []
        self.adapter_ = self._adapter()
        if len(self.classes_) == 2:
            self.program_ = self._head(data, "__y", self.adapter_)
            self.bundle_ = None
        elif self.multiclass == "softmax":
            self.bundle_ = self._softmax(data)
        else:
            heads = []
            for i in range(len(self.classes_)):
                adapter = self.adapter_ if i == 0 else self._adapter()
                heads.append(self._head(data.withColumn("__h", (F.col("__y") == i).cast("int")), "__h", adapter))
            self.bundle_ = Bundle(heads, "softmax", self.classes_)
        return self

    def _states(self, data: DataFrame, target: str, adapter: Adapter) -> DataFrame:
        folds = hashed_fold(F.col(quoted(self.key_)), 3, self.seed)
        return adapter.fit(data, self.columns_, self.key_, target).withColumn("__held", self._fold()).withColumn("__cf", folds).persist()

    def _design(self, adapter: Adapter, mains: list[str], pairs: list[tuple[str, str]]) -> solve.Design:
        return design_of(adapter, mains, pairs, coding=self.coding, fine_pairs=self.fine_pairs)

    def _structures(self, mains: list[str], pairs: list[tuple[str, str]]) -> list[tuple[list[str], list[tuple[str, str]]]]:
        """Numbers of main effects and pairs that are tried."""
        return [(mains[:m], pairs[:p]) for m in sorted({min(8, len(mains)), len(mains)}) for p in sorted({0, min(4, len(pairs)), len(pairs)})]

    @property
    def _penalties(self) -> list[float]:
        return list(self.c) if isinstance(self.c, (tuple, list)) else [self.c]

    def _head(self, data: DataFrame, target: str, adapter: Adapter) -> Program:
        states = self._states(data, target, adapter)
        try:
            mains, pairs = ranked_structure(states, adapter, target, self.max_features, self.pair_features, self.max_pairs, self.pair_ranking, self.key_)
            extra = ["__held", "__cf"] if self.calibration != "none" else ["__held"]
            rows = solve.Rows(states, self._design(adapter, mains, pairs).columns, [target], self.weight, extra=extra)
            structures = self._structures(mains, pairs)
            designs = [self._design(adapter, m, p) for m, p in structures]
            fits = solve.logistic_path(rows, designs, target, self._penalties, ("__held", 0, False))
            losses = solve.mean_losses(rows, [(designs[i], w) for (i, _), w in fits.items()], target, solve.logistic, [("__held", 1, False)] * len(fits))
            tried = [(float(x), program_of(adapter, *structures[i], w, designs[i], "logit").size_bytes(), i, c) for ((i, c), w), x in zip(fits.items(), losses, strict=True)]
            best = min(t[0] for t in tried)
            loss, size, i, c = min((t for t in tried if t[0] <= best + self.near_tie), key=lambda t: (t[1], t[0]))
            (m, p), design = structures[i], designs[i]
            self.diagnostics_.append({"held_out_loss": loss, "best_loss": best, "bytes": size, "mains": m, "pairs": p, "c": c, "candidates": len(tried)})
            w = solve.logistic_l2(rows, design, target, c, start=fits[i, c])
            program = program_of(adapter, m, p, w, design, "logit")
            if self.calibration != "none":
                found = solve.crossfitted_calibration(rows, design, target, c, "__cf", 3, w, self.calibration == "intercept")
                self.diagnostics_[-1] |= {"calibration": (found.scale, found.offset), "calibration_gain": found.gain, "calibration_error": found.error, "calibration_accepted": found.accepted}
                program = program.calibrated(found.scale, found.offset) if found.accepted else program
            return optimised(program)
        finally:
            states.unpersist()

    def _softmax(self, data: DataFrame) -> Bundle:
        """Structures and corrections compared on held-out keys; the chosen ones are fitted again on all rows."""
        adapter, n = self.adapter_, len(self.classes_)
        states = self._states(data, "__y", adapter)
        try:
            mains, pairs = ranked_structure(states, adapter, "__y", min(self.max_features, 8), self.pair_features, min(self.max_pairs, 2))
            rows = solve.Rows(states, design_of(adapter, mains, pairs).columns, ["__y"], self.weight, extra=["__held"])
            tried = []
            for p in sorted({0, len(pairs)}):
                for c in self.c if isinstance(self.c, (tuple, list)) else (self.c,):
                    design = design_of(adapter, mains, pairs[:p])
                    w = solve.softmax_regression(rows.part("__held", 0), design, "__y", n, c)
                    tried.append((_softmax_loss(rows.part("__held", 1), design, "__y", w), design.width * n, p, c))
            best = min(t[0] for t in tried)
            loss, _, p, c = min((t for t in tried if t[0] <= best + self.near_tie), key=lambda t: (t[1], t[0]))
            pairs = pairs[:p]
            design = design_of(adapter, mains, pairs)

            def heads_of(w: np.ndarray) -> list[Program]:
                return [program_of(adapter, mains, pairs, w[:, k], design, "logit") for k in range(n)]

            heads, deltas = heads_of(solve.softmax_regression(rows, design, "__y", n, c)), []
            if self.class_deltas:
                deltas = self._class_deltas(states, heads_of(solve.softmax_regression(rows.part("__held", 0), design, "__y", n, c)), heads)
            self.diagnostics_.append({"mains": mains, "pairs": pairs, "c": c, "held_out_loss": loss, "candidates": len(tried), "class_deltas": deltas})
            return Bundle([optimised(h) for h in heads], "softmax", self.classes_)
        finally:
            states.unpersist()

    def _class_deltas(self, states: DataFrame, trained: list[Program], heads: list[Program]) -> list[tuple[str, int, int, float]]:
        """Corrections (feature, state, class, value), fitted beside ``trained`` on its rows and added to ``heads``.

        Of the numbers of corrections tried the one with the smallest held-out loss is taken, if it gains 0.001 on none
        and costs no more bytes than the heads have.
        """
        adapter, n = self.adapter_, len(heads)
        named = {f.name: F.col(f.state_column) for f in adapter.features}
        z = [h.score(named) for h in trained]
        scored = states.select("*", *[x.alias(f"__z{k}") for k, x in enumerate(z)]).withColumn("__ps", fn.softmax(F.array(*[F.col(f"__z{k}") for k in range(n)])))
        columns = {f.state_column: f.name for f in adapter.features}
        cells = stats.class_cells(scored.where("__held = 0"), list(columns), list(range(n)), "__y", [F.col("__ps")[k] for k in range(n)], self._weight())
        found = [(r["feature"], r["state"], r["class"]) for r in stats.class_descriptors(cells, list(columns), most=self.class_deltas).orderBy("rank").collect()]
        if not found:
            return []
        names = [f"__z{k}" for k in range(n)]
        rows = solve.Rows(scored, [*dict.fromkeys(c for c, *_ in found), *names], ["__y"], self.weight, extra=["__held"])
        values = fit_deltas(rows.part("__held", 0), found, names, "__y")
        tried = prefixes(len(found))

        def work(data, size):
            out, w = np.zeros(len(tried) + 1), data["__w"]
            z = np.column_stack([data[x] for x in names]).astype(float)
            done = 0
            for i, m in enumerate(tried):
                for (c, s, k), v in zip(found[done:m], values[done:m], strict=True):
                    z[:, k] += v * (data[c] == s)
                done = m
                top = z - z.max(axis=1, keepdims=True)
                out[i] = -w @ (top[np.arange(size), data["__y"].astype(int)] - np.log(np.exp(top).sum(axis=1)))
            out[-1] = w.sum()
            return out

        loss = rows.part("__held", 1).sum(work, len(tried) + 1)
        loss = loss[:-1] / max(loss[-1], 1e-12)
        bytes_ = sum(h.size_bytes() for h in heads)
        allowed = [i for i, m in enumerate(tried) if m * 24 <= bytes_]
        i = min(allowed, key=lambda i: (loss[i], i))
        if loss[0] - loss[i] < 0.001:
            return []
        out = []
        for (c, s, k), v in zip(found[: tried[i]], values, strict=False):
            feature = columns[c]
            table = [0.0] * adapter.by_name()[feature].cardinality
            table[s] = v
            heads[k].unary.append((feature, table))
            out.append((feature, s, k, v))
        return out

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with ``probability`` (of the second class) or ``probabilities``, and the predicted class."""
        df = self._checked(df)
        if self.bundle_ is not None:
            return self.bundle_.transform(df, output)
        out = self.program_.transform(df, "probability")
        return out.withColumn(output, F.element_at(F.array(*map(F.lit, self.classes_)), F.when(F.col("probability") >= 0.5, 2).otherwise(1)))

    def score(self, df: DataFrame, target: str, weight: str | None = None) -> float:
        """Accuracy, of weighted rows if a column of weights is named."""
        others = [c for c in df.columns if c not in self.columns_]
        return self.predict(df.select(*map(quoted, [*others, *self.columns_]))).agg(weighted_mean((F.col("prediction") == F.col(quoted(target))).cast("double"), weight)).first()[0]


class SharedClassifier(StateClassifier):
    """Multiclass with one encoding and one set of structures for all classes (softmax)."""

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"multiclass": "softmax"}


def _softmax_loss(rows: solve.Rows, design: solve.Design, target: str, w: np.ndarray) -> float:
    cells = solve.Cells(design)

    def work(b: solve.Batch) -> np.ndarray:
        z = np.stack([cells.score(b, w[:, k]) for k in range(w.shape[1])])
        z -= z.max(axis=0)
        return np.array([-b["__w"] @ (z[b[target].astype(int), np.arange(b.n)] - np.log(np.exp(z).sum(axis=0))), b["__w"].sum()])

    total, mass = solve.Bank(rows, [design]).sum(work, 2)
    return total / mass if mass else float("inf")


class MultiLabelClassifier(Estimator):
    """One head for each 0/1 label; labels that never change become constants; thresholds by F1 on held-out keys or .5."""

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"c": (0.2, 1.0), "threshold": "auto"}

    def fit(self, df: DataFrame, features: list[str], targets: list[str], key: str) -> MultiLabelClassifier:
        df = positive_weight(df, self.weight)
        self._start(df, features, key, 8)
        w = self._weight() if self.weight else F.lit(1.0)
        share = df.agg(*[(F.sum(w * F.col(quoted(t))) / F.sum(F.when(F.col(quoted(t)).isNotNull(), w))).alias(f"s{i}") for i, t in enumerate(targets)]).first()
        heads, cuts, self.labels_, self.adapter_ = [], [], list(targets), self._adapter()
        for i, t in enumerate(targets):
            if share[i] in (0.0, 1.0):
                heads.append(constant_program(share[i]))
                cuts.append(0.5)
                continue
            own = {k: v for k, v in self.params.items() if k != "threshold"}
            head = StateClassifier(**own).fit(df, features, t, key)
            self.adapter_ = head.adapter_
            heads.append(head.program_)
            cuts.append(0.5)
            if self.threshold == "auto":
                held = head.predict(df.where(self._fold() == 1)).select(F.round("probability", 6).alias("p"), F.col(quoted(t)).alias("t"), w.alias("w"))
                row = stats.best_f1_threshold(held, "p", "t", weight=F.col("w")).first()
                cuts[-1] = float(row[0]) if row and row[0] is not None else 0.5
        self.bundle_ = Bundle(heads, "labels", self.labels_, cuts)
        return self

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.bundle_.transform(self._checked(df), output)
