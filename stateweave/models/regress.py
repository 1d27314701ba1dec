"""Regressors with finite-state structure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import quantiles, rank, solve, stats
from ..plans.program import Feature, Program
from ..plans.rewrite import optimised
from ..schema import ParameterError, ValidationError, quoted
from .base import Adapter, Estimator, positive_weight, weighted_mean
from .classify import design_of, program_of


def ranked_by_variance(states: DataFrame, adapter: Adapter, target: str, max_features: int, pair_features: int, max_pairs: int) -> tuple[list[str], list[tuple[str, str]]]:
    """The best single features and pairs by the variance of the target that they explain (earlier columns first)."""
    name = {f.state_column: f.name for f in adapter.features}
    columns, y = list(name), F.col(quoted(target)).cast("double")
    weight = F.col(quoted(adapter.weight)).cast("double") if adapter.weight else None
    w = weight if weight is not None else F.lit(1.0)
    sums = {"v": w * y, "vv": w * y * y}
    one = stats.between_share(stats.state_cells(states, columns, sums=sums, weight=weight), ["feature"]).fillna(0.0)
    best = [r["feature"] for r in rank.top_features(one, columns, "eta2", max_features).orderBy("rank").collect()]
    chosen = best[:pair_features]
    if len(chosen) < 2 or max_pairs < 1:
        return [name[c] for c in best], []
    two = stats.between_share(stats.tuple_cells(states, stats.pairs_of(chosen), sums=sums, weight=weight), ["f0", "f1"]).fillna(0.0)
    top = rank.top_pairs(rank.with_marginals(two, one, "eta2", "sum"), columns, "excess", max_pairs, later_first=False).orderBy("rank").collect()
    return [name[c] for c in best], [(name[r["f0"]], name[r["f1"]]) for r in top]


class _Regressor(Estimator):
    def _prepare(self, df: DataFrame, features: list[str], target: str, key: str) -> DataFrame:
        df = positive_weight(df, self.weight)
        self._start(df, features, key, 8)
        y = F.col(quoted(target)).cast("double")
        if df.where(y.isNull() | F.isnan(y)).limit(1).count():
            raise ValidationError("the target has missing values")
        self.adapter_ = self._adapter(missing_as_key=True)
        return self.adapter_.fit(df, features, key, target).withColumn("__held", self._fold()).withColumn("__t", y).persist()

    def _linear(self, states: DataFrame) -> list[tuple[str, float, float, float]]:
        """Numeric columns that also enter linearly: column, median, mean, population deviation (after imputation)."""
        numeric = [f for f in self.adapter_.features if f.kind == "numeric"]
        if not numeric:
            return []
        from ..operators.adapt import imputed

        w, x = self._weight() if self.weight else F.lit(1.0), [imputed(f.column, f.median)[0] for f in numeric]
        mean = [F.sum(w * v) / F.sum(w) for v in x]
        centre = states.agg(*mean).first()
        spread = states.agg(*[F.sqrt(F.sum(w * (v - F.lit(m)) ** 2) / F.sum(w)) for v, m in zip(x, centre, strict=True)]).first()
        return [(f.column, f.median, m, s if s and s > 1e-12 else 1.0) for f, m, s in zip(numeric, centre, spread, strict=True)]

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.program_.transform(self._checked(df), output)

    def score(self, df: DataFrame, target: str, weight: str | None = None) -> float:
        """R squared; of several quantiles minus the mean pinball loss.  Of weighted rows if a column of weights is named."""
        y = F.col(quoted(target)).cast("double")
        if getattr(self, "programs_", None) and isinstance(self.programs_, list) and len(self.programs_) > 1:
            losses = [stats.pinball(y, F.col("prediction")[i], q) for i, q in enumerate(self.quantiles)]
            return -self.predict(df).agg(weighted_mean(fn.total(losses, 0.0) / len(losses), weight)).first()[0]
        centre = df.agg(weighted_mean(y, weight)).first()[0]
        r = self.predict(df).agg(*[weighted_mean((F.col("prediction") - y) ** 2, weight), weighted_mean((F.lit(centre) - y) ** 2, weight)]).first()
        return 1 - r[0] / r[1]


class StateRidgeRegressor(_Regressor):
    """Linear terms and tables of states and pairs by ridge regression.

    One pass gives the Gram matrices of the widest design on both sides of the holdout; every candidate (numbers of
    features and pairs, penalty) is a block of them and costs no further pass.  Within one standard error of the best
    held-out error the smallest design wins, and is solved on all rows.
    """

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"alpha": (0.1, 1.0, 10.0)}

    def fit(self, df: DataFrame, features: list[str], target: str, key: str) -> StateRidgeRegressor:
        states = self._prepare(df, features, target, key)
        try:
            self.program_, self.diagnostics_ = self._fit(states)
        finally:
            states.unpersist()
        return self

    def _fit(self, states: DataFrame) -> tuple[Program, dict]:
        mains, pairs = ranked_by_variance(states, self.adapter_, "__t", self.max_features, self.pair_features, self.max_pairs)
        linear = self._linear(states)
        from ..operators.adapt import imputed

        wide = states.select("*", *[imputed(c, md)[0].alias(f"__x_{i}") for i, (c, md, _, _) in enumerate(linear)])
        design = design_of(self.adapter_, mains, pairs, [(f"__x_{i}", m, s) for i, (_, _, m, s) in enumerate(linear)])
        rows = solve.Rows(wide, design.columns, ["__t"], self.weight, extra=["__held"])
        train, held = solve.grams(rows, design, ["__t"], "__held", (0, 1))
        n_held = held[0][0, 0]
        edges = np.cumsum([0, *design.widths])
        block = [np.arange(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        lin = block[1 + len(mains) + len(pairs) :]
        tried = []
        for m in sorted({min(4, len(mains)), len(mains)}):
            for p in sorted({0, min(8, len(pairs)), len(pairs)}):
                use = np.concatenate([block[0], *block[1 : 1 + m], *block[1 + len(mains) : 1 + len(mains) + p], *lin]).astype(int)
                for alpha in self.alpha if isinstance(self.alpha, (tuple, list)) else (self.alpha,):
                    w = solve.ridge_from_gram(train[0], train[1], alpha, use)
                    tried.append((float(solve.squared_error(*held, w)[0] / max(n_held, 1)), len(use), alpha, use))
        best = min(tried, key=lambda t: t[0])
        w_best = solve.ridge_from_gram(train[0], train[1], best[2], best[3])[:, 0]

        cells = solve.Cells(design)

        def work(b: solve.Batch) -> np.ndarray:  # squares and fourth powers of the held-out residuals
            r, w = (cells.score(b, w_best) - b["__t"]) ** 2, b["__w"] * (b["__held"] == 1)
            return np.array([w @ r, w @ r**2])

        squares, fourth = solve.Bank(rows, [design]).sum(work, 2) / max(n_held, 1)
        error = np.sqrt(max(0.0, fourth - squares**2) / max(n_held, 1))  # of the mean of squares
        mse, _, alpha, use = min((t for t in tried if t[0] <= best[0] + error), key=lambda t: (t[1], t[0], t[2]))
        w = solve.ridge_from_gram(train[0] + held[0], train[1] + held[1], alpha, use)[:, 0]
        program = optimised(program_of(self.adapter_, mains, pairs, w, design, "identity", linear))
        return program, {"held_out_mse": mse, "alpha": alpha, "columns": len(use), "candidates": len(tried), "mains": mains, "pairs": pairs}


class FusedRegressor(_Regressor):
    """A ridge baseline, corrected by the distribution of its residuals.

    A logistic head on the same states, whose coefficients vary smoothly over thresholds (``head="separate"``: one head
    each), gives the probability that the residual exceeds each of some thresholds; their integral is a second estimate of the residual's mean.  A factor in [0, 1] is fitted on held-out keys and the
    correction is kept if it lowers the held-out RMSE by ``least_gain``, else the baseline stands alone.
    """

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"alpha": (0.1, 1.0, 10.0), "thresholds": 10, "c": 0.05, "head": "spline", "least_gain": 0.01, "max_features": 24, "max_pairs": 4}

    def fit(self, df: DataFrame, features: list[str], target: str, key: str) -> FusedRegressor:
        states = self._prepare(df, features, target, key)
        try:
            ridge = StateRidgeRegressor(**{k: v for k, v in self.params.items() if k in StateRidgeRegressor.defaults()})
            ridge.adapter_, ridge.columns_, ridge.key_ = self.adapter_, self.columns_, self.key_
            self.baseline_, base = ridge._fit(states)
            named = {f.name: F.col(f.state_column) for f in self.adapter_.features}
            work = states.withColumn("__r", F.col("__t") - self.baseline_.score(named))
            cuts = sorted(set(quantiles.exact_quantiles(work, ["__r"], [(i + 0.5) / self.thresholds for i in range(self.thresholds)], self.weight)["__r"]))
            lower, upper = work.agg(F.min("__r"), F.max("__r")).first()
            mains, pairs = base["mains"][: self.max_features], base["pairs"][: self.max_pairs]
            design = design_of(self.adapter_, mains, pairs)
            labels = [f"__b{i}" for i in range(len(cuts))]
            marked = work.select("*", *[(F.col("__r") > F.lit(t)).cast("int").alias(b) for b, t in zip(labels, cuts, strict=True)])
            rows = solve.Rows(marked, design.columns, labels, self.weight, extra=["__held"])
            basis = solve.spline_basis(cuts)

            def heads_of(part: solve.Rows) -> list[Program]:
                if self.head == "separate":
                    return [program_of(self.adapter_, mains, pairs, solve.logistic_l2(part, design, b, self.c), design, "logit") for b in labels]
                w = solve.threshold_head(part, design, labels, basis, 1 / self.c)
                return [program_of(self.adapter_, mains, pairs, w[:, i], design, "logit") for i in range(len(labels))]

            self._heads = heads_of(rows.part("__held", 0))
            self._curve = (float(lower), cuts, float(upper))
            shift = self._correction(self._heads, named)
            held = work.where("__held = 1").select(F.col("__r").alias("r"), shift.alias("d"), (self._weight() if self.weight else F.lit(1.0)).alias("w"))
            s = held.agg(F.sum(F.col("w") * F.col("r") * F.col("d")), F.sum(F.col("w") * F.col("d") ** 2), F.sum(F.col("w") * F.col("r") ** 2)).first()
            self.gamma_ = float(np.clip(s[0] / s[1], 0, 1)) if s[1] else 0.0
            gain = 1 - np.sqrt(max(0.0, 1 - (2 * self.gamma_ * s[0] - self.gamma_**2 * s[1]) / s[2])) if s[2] else 0.0
            self.branch_ = "fused" if gain >= self.least_gain else "baseline"
            if self.branch_ == "fused":
                self._heads = [optimised(h) for h in heads_of(rows)]
            self.diagnostics_ = base | {"gamma": self.gamma_, "gain": float(gain), "branch": self.branch_}
        finally:
            states.unpersist()
        return self

    def _survival(self, heads: list[Program], states: dict[str, Column] | None = None) -> list[Column]:
        each = [fn.sigmoid(h.score({k: v for k, v in states.items() if k in h.features} if states else None)) for h in heads]
        out: list[Column] = []
        for p in each:
            out.append(F.least(out[-1], p) if out else p)
        return out

    def _correction(self, heads: list[Program], states: dict[str, Column] | None = None) -> Column:
        lower, cuts, upper = self._curve
        return fn.survival_mean(lower, cuts, upper, self._survival(heads, states))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        out = self.baseline_.transform(self._checked(df), output)
        if self.branch_ == "fused":
            out = out.withColumn(output, F.col(output) + self.gamma_ * self._correction(self._heads))
        return out

    def predict_survival(self, df: DataFrame, output: str = "survival") -> DataFrame:
        """Probabilities that the residual exceeds each threshold (all 0 where the baseline stands alone)."""
        df = self._checked(df)
        return df.withColumn(output, F.array(*(self._survival(self._heads) if self.branch_ == "fused" else [F.lit(0.0)] * len(self._heads))))


class ResolutionRegressor(_Regressor):
    """Numeric columns at several independent resolutions at once, every state with a column of its own.

    States of 4, 8 and 16 quantile cells of each column and the best pairs of 8-cell states enter one penalised ridge
    regression without reference states; the penalty is chosen on held-out keys.  One Gram matrix for each side.
    """

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"alpha": (1.0, 10.0, 100.0), "levels": (4, 8, 16), "pair_level": 8, "max_pairs": 6, "max_features": 24}

    def fit(self, df: DataFrame, features: list[str], target: str, key: str) -> ResolutionRegressor:
        df = positive_weight(df, self.weight)
        self._start(df, features, key, 8)
        y = F.col(quoted(target)).cast("double")
        if df.where(y.isNull() | F.isnan(y)).limit(1).count():
            raise ValidationError("the target has missing values")
        from ..operators.adapt import medians

        middle = medians(df, self.columns_, self.weight)
        cuts = quantiles.nested_thresholds(df, self.columns_, tuple(self.levels), digits=9, weight=self.weight)
        made = {(c, b): Feature(f"raw{b}:{c}", "numeric", c, len(cuts[c][b]) + 1, middle[c], cuts[c][b]) for c in self.columns_ for b in self.levels}
        self.adapter_ = Adapter(bins=max(self.levels), weight=self.weight, features=list(made.values()), columns=list(self.columns_))
        states = self.adapter_.transform(df).withColumn("__held", self._fold()).withColumn("__t", y).persist()
        try:
            level = Adapter(weight=self.weight, features=[made[c, self.pair_level] for c in self.columns_])
            ranked, pairs = ranked_by_variance(states, level, "__t", self.max_features, self.pair_features, self.max_pairs)
            chosen = {f.split(":", 1)[1] for f in ranked}
            mains = [f.name for (c, _), f in made.items() if c in chosen]
            f = self.adapter_.by_name()
            # codes from 1 leave the reference state, 0, unused
            one = lambda n: f"{f[n].state_column}__1"
            coded = states.select("*", *[(F.col(f[n].state_column) + 1).alias(one(n)) for n in mains], *[(F.col(f[a].state_column) * f[b].cardinality + F.col(f[b].state_column) + 1).alias(f"__pair{i}") for i, (a, b) in enumerate(pairs)])
            sizes = [f[n].cardinality for n in mains] + [f[a].cardinality * f[b].cardinality for a, b in pairs]
            design = solve.Design([(c, k + 1) for c, k in zip([*map(one, mains), *[f"__pair{i}" for i in range(len(pairs))]], sizes, strict=True)])
            rows = solve.Rows(coded, design.columns, ["__t"], self.weight, extra=["__held"])
            train, held = solve.grams(rows, design, ["__t"], "__held", (0, 1))
            tried = [(float(solve.squared_error(*held, solve.ridge_from_gram(train[0], train[1], a))[0] / max(held[0][0, 0], 1)), a) for a in self.alpha]
            mse, alpha = min(tried, key=lambda t: (t[0], -t[1]))
            parts = design.split(solve.ridge_from_gram(train[0] + held[0], train[1] + held[1], alpha)[:, 0])
            unary = [(n, list(map(float, p))) for n, p in zip(mains, parts[1:], strict=False)]
            tables = [(a, b, p.reshape(f[a].cardinality, f[b].cardinality).tolist()) for (a, b), p in zip(pairs, parts[1 + len(mains) :], strict=True)]
            self.program_ = optimised(Program(f, float(parts[0][0]), unary, tables))
            self.diagnostics_ = {"held_out_mse": mse, "alpha": alpha, "columns": design.width, "mains": mains, "pairs": pairs}
        finally:
            states.unpersist()
        return self


class GeneralizedRegressor(_Regressor):
    """Other objectives on finite-state designs: squared, huber, quantile (one or several), poisson, gamma, tweedie.

    ``offset`` (added to the score) and ``exposure`` (multiplies the mean; log links) name columns.  Quantiles are
    smoothed in a narrow band under a penalty on squares, or solved as linear programmes with ``penalty="l1"``: then
    ``alpha`` weighs the coefficients' sizes against the mean loss, and ``gaps_`` bounds each solution's distance from
    the optimum.
    """

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"loss": "squared", "alpha": 1.0, "quantiles": (0.5,), "power": 1.5, "epsilon": 1.35, "penalty": "l2", "offset": None, "exposure": None, "max_features": 16, "max_pairs": 2}

    LOG = ("poisson", "gamma", "tweedie")

    def fit(self, df: DataFrame, features: list[str], target: str, key: str) -> GeneralizedRegressor:
        if self.loss not in ("squared", "huber", "quantile", *self.LOG):
            raise ParameterError(f"loss {self.loss!r}")
        if self.penalty not in ("l2", "l1") or self.penalty == "l1" and self.loss != "quantile":
            raise ParameterError(f"penalty {self.penalty!r} of loss {self.loss!r}")
        y = F.col(quoted(target)).cast("double")
        low = df.agg(F.min(y)).first()[0]
        if self.loss in self.LOG and low is not None and (low < 0 or (self.loss == "gamma" and low <= 0)):
            raise ValidationError(f"{self.loss}: the target must be {'positive' if self.loss == 'gamma' else 'at least 0'}")
        states = self._prepare(df, features, target, key)
        try:
            shift = F.lit(0.0)
            if self.offset:
                shift = shift + F.col(quoted(self.offset)).cast("double")
            if self.exposure:
                shift = shift + F.log(F.col(quoted(self.exposure)).cast("double"))
            goal = F.log1p(F.col("__t") * F.exp(-shift)) if self.loss in self.LOG else F.col("__t") - shift
            states = states.withColumn("__o", shift).withColumn("__g", goal)
            mains, pairs = ranked_by_variance(states, self.adapter_, "__g", self.max_features, self.pair_features, self.max_pairs)
            design = design_of(self.adapter_, mains, pairs)
            rows = solve.Rows(states, design.columns, ["__t"], self.weight, extra=["__o"])
            start = np.zeros(design.width)
            w = self._weight() if self.weight else F.lit(1.0)
            mean = states.agg(F.sum(w * F.col("__t")) / F.sum(w)).first()[0]
            spread = states.agg(F.sqrt(F.sum(w * (F.col("__t") - F.lit(mean)) ** 2) / F.sum(w))).first()[0]
            start[0] = np.log(max(mean, 1e-9)) if self.loss in self.LOG else mean
            self.programs_, self.gaps_ = [], []
            for q in self.quantiles if self.loss == "quantile" else (None,):
                loss = {"squared": solve.squared, "poisson": solve.poisson, "gamma": solve.gamma, "tweedie": solve.tweedie(self.power)}.get(self.loss) or solve.pinball(q, 0.05 * (spread or 1.0))
                if self.penalty == "l1":
                    w, gap = solve.quantile_regression(rows, design, "__t", q, self.alpha, "__o", start.copy(), spread or 1.0)
                    self.gaps_.append(gap)
                elif self.loss == "huber":
                    w, self.scale_ = solve.huber_regression(rows, design, "__t", self.epsilon, self.alpha, "__o", start.copy(), spread or 1.0)
                else:
                    w = solve.newton(rows, design, "__t", loss, self.alpha, False, offset="__o", start=start.copy())
                self.programs_.append(optimised(program_of(self.adapter_, mains, pairs, w, design, "log" if self.loss in self.LOG else "identity")))
            self.program_ = self.programs_[0]
            self.diagnostics_ = {"mains": mains, "pairs": pairs, "width": design.width}
        finally:
            states.unpersist()
        return self

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """One value, or an array of quantiles that don't cross."""
        df = self._checked(df)
        offset = F.col(quoted(self.offset)).cast("double") if self.offset else None
        exposure = F.col(quoted(self.exposure)).cast("double") if self.exposure else None
        values = [p.value(offset=offset, exposure=exposure) for p in self.programs_]
        return df.withColumn(output, values[0] if len(values) == 1 else F.array(*fn.running_max(values)))


class MultiOutputRegressor(_Regressor):
    """Several targets on one design: one Gram matrix, a right side for each.

    ``mode``: "shared" ranks structure by the mean of the standardised targets; "subspace" by the directions of the
    targets' correlations that stand out of noise; "independent" fits each target by a regressor of its own.  Where no
    direction stands out, "subspace" is "independent" (``strategy_`` tells what was done).
    """

    MODES = ("shared", "subspace", "independent")

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"alpha": 1.0, "mode": "subspace", "max_features": 16, "max_pairs": 4}

    def fit(self, df: DataFrame, features: list[str], targets: list[str], key: str) -> MultiOutputRegressor:
        if self.mode not in self.MODES:
            raise ParameterError(f"mode {self.mode!r}")
        df = positive_weight(df, self.weight)
        yy = np.array(stats.gram(df, targets, self._weight()))
        n = yy[0, 0]
        mean = yy[0, 1:] / n
        sd = np.sqrt(np.maximum(np.diag(yy)[1:] / n - mean**2, 1e-24))
        self.values_, vectors, self.rank_ = solve.output_spectrum(yy, n)
        self.strategy_ = "independent" if self.mode == "subspace" and not self.rank_ else self.mode
        if self.strategy_ == "independent":
            return self._fit_each(df, features, targets, key)
        directions = [vectors[:, k] for k in range(self.rank_)] if self.mode == "subspace" else [np.ones(len(targets)) / len(targets)]
        standard = [(F.col(quoted(t)).cast("double") - float(m)) / float(s) for t, m, s in zip(targets, mean, sd, strict=True)]
        joint = df.select("*", *[fn.total([x * float(v) for x, v in zip(standard, d, strict=True)], 0.0).alias(f"__d{i}") for i, d in enumerate(directions)])
        states = self._prepare(joint, features, "__d0", key)
        try:
            order: list[str] = []
            pairs: list[tuple[str, str]] = []
            found = [ranked_by_variance(states, self.adapter_, f"__d{i}", self.max_features, self.pair_features, self.max_pairs) for i in range(len(directions))]
            for depth in range(self.max_features):  # in turn from every direction
                for mains, _ in found:
                    if depth < len(mains) and mains[depth] not in order:
                        order.append(mains[depth])
            for depth in range(self.max_pairs):
                for _, p in found:
                    if depth < len(p) and p[depth] not in pairs:
                        pairs.append(p[depth])
            order, pairs = order[: self.max_features], pairs[: self.max_pairs]
            design = design_of(self.adapter_, order, pairs)
            xx, xy, _ = solve.gram(solve.Rows(states, design.columns, targets, self.weight), design, targets)
            w = solve.ridge_from_gram(xx, xy, self.alpha)
            self.programs_ = {t: optimised(program_of(self.adapter_, order, pairs, w[:, i], design, "identity")) for i, t in enumerate(targets)}
            self.diagnostics_ = {"rank": self.rank_, "mains": order, "pairs": pairs}
        finally:
            states.unpersist()
        return self

    def _fit_each(self, df: DataFrame, features: list[str], targets: list[str], key: str) -> MultiOutputRegressor:
        common = {k: v for k, v in self.params.items() if k in StateRidgeRegressor.defaults()}
        parts = {t: StateRidgeRegressor(**common).fit(df, features, t, key) for t in targets}
        first = parts[targets[0]]
        self.adapter_, self.columns_, self.key_ = first.adapter_, first.columns_, first.key_
        self.programs_ = {t: p.program_ for t, p in parts.items()}
        self.diagnostics_ = {"rank": self.rank_, "targets": {t: p.diagnostics_ for t, p in parts.items()}}
        return self

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """A column ``prediction_<target>`` for each target."""
        df = self._checked(df)
        return df.select("*", *[p.value().alias(f"{output}_{t}") for t, p in self.programs_.items()])
