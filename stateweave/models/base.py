"""What all estimators share: adaptation of typed columns, splits by key, resources, storage."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..keys import column_sample, hashed_fold
from ..operators import adapt, quantiles
from ..operators.cache import HistogramCache
from ..plans.program import Feature
from ..schema import ParameterError, ResourceLimitError, ResourceWarning_, ValidationError, aligned, check_names, infer_roles, physical, quoted
from ..sources.interim import stored


@dataclass
class Adapter:
    """Typed columns to states.

    Numeric columns are imputed by the median and cut at nested quantiles; a flag marks missing values ("observed": if
    there are any, "always", "none").  Categories with few values are states by sorted value (or binary digits of it),
    others are ordered by smoothed target means, out of fold while fitting.  Embeddings ("basic") become states of the
    difference of their distances to two class centroids and of their leading principal directions, or ("prototype")
    of the difference of their distances to the nearest of several centres of each class and of a linear discriminant;
    components are scaled for these, and what is made of classes is out of fold while fitting, too.  Vectors that are null, of
    another length than most or hold null or non-finite components get the last state.  Weights count in medians,
    thresholds, means, centroids and directions; rows of weight 0 have to be left out before.
    """

    bins: int = 16
    max_identity: int = 16
    category_bins: int = 8
    smoothing: float = 20.0
    missing_policy: str = "observed"
    category_identity: str = "state"
    folds: int = 5
    embedding: str = "basic"
    components: int = 8
    prototypes: int = 8
    missing_as_key: bool = False
    weight: str | None = None
    features: list[Feature] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, columns: list[str], key: str, target: str) -> DataFrame:
        """``df`` with a state column for each adapted feature (out of fold where targets are used)."""
        check_names(df)
        self.columns, roles = list(columns), infer_roles(df, columns)
        self.features = []
        out = df
        numeric = roles["numeric"]
        if numeric:
            middle = adapt.medians(df, numeric, self.weight)
            flags = df.agg(*[F.count_if(F.coalesce(adapt.imputed(c, 0.0)[1] == 1, F.lit(True))).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
            cuts = quantiles.nested_thresholds(df, numeric, (self.bins,), digits=9, weight=self.weight)
            for i, c in enumerate(numeric):
                self.features.append(Feature(f"num:{c}", "numeric", c, len(cuts[c][self.bins]) + 1, middle[c], cuts[c][self.bins]))
                if self.missing_policy == "always" or (self.missing_policy == "observed" and flags[i]):
                    self.features.append(Feature(f"missing:{c}", "missing", c, 2))
        modes = adapt.category_mode(df, roles["category"], self.max_identity) if roles["category"] else {}
        for c in roles["category"]:
            if modes[c] == "identity":
                values = [r[0] for r in adapt.dictionary(df, c).orderBy("state").select("value").collect()]
                reserve = self.missing_policy != "none"
                size = len(values) + reserve
                if self.category_identity == "bits":
                    self.features += [Feature(f"catbit:{c}:{b}", "category_bit", c, 2, values=values, bit=b, reserved=reserve) for b in range(max(1, (size - 1).bit_length()))]
                else:
                    self.features.append(Feature(f"catid:{c}", "category", c, size, values=values, reserved=reserve))
            else:
                out = self._ordered(out, c, key, target)
        for c in roles["embedding"]:
            out = self._embedding(out, c, key, target)
        states = [f.expression().alias(f.state_column) for f in self.features if f.state_column not in out.columns]
        return out.select("*", *states)

    def _ordered(self, df: DataFrame, column: str, key: str, target: str) -> DataFrame:
        y = F.col(quoted(target)).cast("double")
        name = f"catq:{column}"
        w = F.col(quoted(self.weight)).cast("double") if self.weight else None
        folded = df.withColumn("__fold", hashed_fold(F.col(quoted(key)), self.folds))
        if self.missing_as_key:
            folded = folded.withColumn(column, F.coalesce(F.col(quoted(column)).cast("string"), F.lit(adapt.MISSING_KEY)))
        scored = adapt.out_of_fold_scores(folded, column, y, "__fold", self.smoothing, weight=w)
        cuts = quantiles.nested_thresholds(scored, ["score"], (self.category_bins,), digits=9, weight=self.weight)["score"][self.category_bins]
        table, mean = adapt.fitted_scores(folded, column, y, self.smoothing, w)
        if table.limit(adapt.BROADCAST_CATEGORIES + 1).count() > adapt.BROADCAST_CATEGORIES:
            raise ResourceLimitError(f"{column!r} has over {adapt.BROADCAST_CATEGORIES} values; group rare ones first")
        rows = table.orderBy("value").collect()
        f = Feature(name, "ordered", column, len(cuts) + 2, thresholds=cuts, values=[r[0] for r in rows], scores=[float(r[1]) for r in rows], default=float(mean), reserved=not self.missing_as_key)
        self.features.append(f)
        s = fn.state(F.round("score", 9), cuts) + 1
        s = s if self.missing_as_key else F.when(F.col(quoted(column)).isNull(), 0).otherwise(s)
        out = scored.withColumn(f.state_column, s.cast("int")).drop("score", "__fold")
        return out.withColumn(column, F.nullif(F.col(quoted(column)), F.lit(adapt.MISSING_KEY))) if self.missing_as_key else out

    def _embedding(self, df: DataFrame, column: str, key: str, target: str) -> DataFrame:
        """States of directions that tell the halves of the target apart (out of fold while fitting) and of principal ones."""
        y = F.col(quoted(target)).cast("double")
        w = F.col(quoted(self.weight)).cast("double") if self.weight else None
        middle = quantiles.exact_quantiles(df, [target], [0.5], self.weight)[target][0]
        upper = y > middle if df.where(y > middle).limit(1).count() else y >= middle
        fold = hashed_fold(F.col(quoted(key)), self.folds)
        moments = adapt.Moments.of(df, column, upper.cast("int"), fold, self.folds, w)
        if not moments.g[..., 0, 0].any():
            return df
        scale = moments.scale()
        made: list[tuple[Feature, list[Column]]] = []  # the feature, and its value by a fit without each fold

        def supervised(name: str, fit) -> None:
            whole, others = fit(None), [fit(k) for k in range(self.folds)]
            if whole is not None and all(o is not None for o in others):
                feature = lambda o: Feature(name, "projection", column, 0, scores=[*o[0].tolist(), *o[1].tolist()])
                made.append((feature(whole), [feature(o).direction() for o in others]))

        if self.embedding == "prototype":
            centres = adapt.fold_prototypes(df.withColumn("__c", upper.cast("int")), column, "__c", fold, self.folds, self.prototypes, weight=w, scale=scale)
            if min(len(v) for both in centres for v in both.values()):
                flat = lambda both: np.concatenate([both[0] / scale, both[1] / scale]).ravel().tolist()
                feature = lambda both: Feature(f"embp:{column}", "prototype", column, 0, scores=[*scale.tolist(), *flat(both)], shape=[len(both[0]), len(both[1])])
                made.append((feature(centres[-1]), [feature(both).direction() for both in centres[:-1]]))
            supervised(f"embl:{column}", moments.discriminant)
        else:
            supervised(f"embq:{column}", moments.centroid)
            if self.components:
                mean, directions, _ = moments.principal(self.components)
                for i, d in enumerate(directions):
                    f = Feature(f"embc:{column}:{i}", "projection", column, 0, scores=mean.tolist() + d.tolist())
                    made.append((f, []))
        value = [f.direction() if not others else F.coalesce(*[F.when(fold == k, x) for k, x in enumerate(others)]) for f, others in made]
        d = df.select("*", *[v.alias(f"__d{i}") for i, v in enumerate(value)])
        cuts = quantiles.nested_thresholds(d, [f"__d{i}" for i in range(len(made))], (self.category_bins,), digits=9, weight=self.weight) if made else {}
        states = []
        for i, (f, _) in enumerate(made):
            f.thresholds = cuts[f"__d{i}"][self.category_bins]
            f.cardinality = len(f.thresholds) + 1
            if f.cardinality > 1:
                self.features.append(f)
                states.append(fn.state(F.round(F.col(f"__d{i}"), 9), f.thresholds).cast("int").alias(f.state_column))
        return d.select(*[F.col(quoted(c)) for c in df.columns], *states)

    def transform(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """``df`` with the state columns of all fitted features, or of those named."""
        wanted = [f for f in self.features if columns is None or f.name in columns]
        return df.select("*", *[f.expression().alias(f.state_column) for f in wanted])

    def size_bytes(self) -> int:
        """Bytes of thresholds, dictionaries and centres."""
        return sum(8 * (len(f.thresholds) + len(f.scores)) + sum(len(v.encode()) for v in f.values) for f in self.features)

    def by_name(self) -> dict[str, Feature]:
        return {f.name: f for f in self.features}


@dataclass
class ResourcePlan:
    """An estimate of a fit from its shape, made before any data is read twice."""

    rows: int
    features: int
    pair_evaluations: int
    cells_mb: float
    violations: list[str]


def resource_plan(rows: int, features: int, pair_features: int, bins: int, max_cells_mb: float = 4096.0, max_pairs: int = 2_000_000, policy: str = "raise") -> ResourcePlan:
    """``policy``: "raise", "warn" or "ignore" when a budget is exceeded."""
    k = min(features, pair_features)
    pairs = k * (k - 1) // 2
    mb = (features * bins + pairs * bins * bins) * 40 / 1e6
    wrong = [f"cells: {mb:.0f} MB of {max_cells_mb:.0f}"] * (mb > max_cells_mb) + [f"pairs: {pairs} of {max_pairs}"] * (pairs > max_pairs)
    plan = ResourcePlan(rows, features, pairs, mb, wrong)
    if wrong and policy == "raise":
        raise ResourceLimitError("; ".join(wrong) + "; lower the number of pair features or bins, or raise the budget")
    if wrong and policy == "warn":
        warnings.warn("; ".join(wrong), ResourceWarning_, stacklevel=2)
    return plan


class Estimator:
    """Parameters by name, fitted columns, and the checks around fit and predict."""

    # Other names of parameters.
    ALIASES: dict[str, str] = {"feature_budget": "max_features", "interaction_budget": "max_pairs", "l2_regularization": "alpha", "state_detail": "bins"}

    def __init__(self, **params):
        self.params = dict(self.defaults())
        self.set_params(**params)

    @classmethod
    def defaults(cls) -> dict:
        return {"max_features": 64, "pair_features": 12, "max_pairs": 8, "bins": 16, "holdout": 0.22, "seed": 7, "near_tie": 0.0015, "resource_policy": "raise", "weight": None, "embedding": "basic", "colsample": 1.0}

    def set_params(self, **params):
        given: dict = {}
        for name, v in params.items():
            own = self.ALIASES.get(name, name)
            if own not in self.params:
                raise ParameterError(f"unknown parameter {name!r}; there are {sorted(self.params)}")
            if own in given and given[own] != v:
                from ..schema import AliasConflictError

                raise AliasConflictError(f"{name!r} contradicts {own!r}")
            given[own] = v
        self.params.update(given)
        return self

    def get_params(self) -> dict:
        return dict(self.params)

    def tunable_params(self) -> list[str]:
        return [p for p in self.params if p in ("max_features", "pair_features", "max_pairs", "bins", "alpha", "c", "smoothing")]

    def search_params(self) -> list[str]:
        return [p for p in self.params if p in ("holdout", "seed", "near_tie")]

    def resource_params(self) -> list[str]:
        return [p for p in self.params if p in ("resource_policy", "pair_features")]

    def clone(self):
        return type(self)(**self.params)

    def __getattr__(self, name):
        if name != "params" and name in self.__dict__.get("params", {}):
            return self.params[name]
        raise AttributeError(name)

    def _start(self, df: DataFrame, features: list[str], key: str, least: int) -> None:
        check_names(df)
        missing = [c for c in [*features, key] if c not in df.columns]
        if missing:
            raise ValidationError(f"no such columns: {missing}")
        n = df.count()
        if n < least:
            raise ValidationError(f"{n} rows; {least} are needed")
        self.columns_, self.key_ = column_sample(list(features), self.colsample, self.seed) if self.colsample < 1 else list(features), key
        self.plan_ = resource_plan(n, len(features), self.pair_features, self.bins, policy=self.resource_policy)
        if self.weight:
            quantiles.check_weights(df, self.weight)

    def _fold(self) -> Column:
        """1 for held-out keys."""
        return (F.pmod(F.xxhash64(F.lit(self.seed), F.col(quoted(self.key_))), F.lit(10_000)) < int(self.holdout * 10_000)).cast("int")

    def _checked(self, df: DataFrame) -> DataFrame:
        """The fitted columns, with the others carried along untouched in front."""
        others = [c for c in df.columns if c not in self.columns_]
        return aligned(df, self.columns_, keep=others)

    def _weight(self) -> Column | None:
        return F.col(quoted(self.weight)).cast("double") if self.weight else None

    def _adapter(self, **options) -> Adapter:
        return Adapter(bins=self.bins, weight=self.weight, embedding=self.embedding, **options)

    def newton_cache(self, df: DataFrame, features: list[str], target: str, key: str, prediction: str = "base", pair_features: int | None = None) -> tuple[HistogramCache, float]:
        """Histograms of gradients and Hessians by state and by pair of states, and the rows' weight.

        ``prediction="base"``: at the overall mean, on states of an adapter fitted here; pairs are those of the
        ``pair_features`` features with the largest gains.  ``"model"``: at what the fitted program predicts, on its own
        states: what it has left to explain.  Two classes count as 0 and 1; other targets as numbers with squared loss.
        """
        df = positive_weight(df, self.weight)
        w = self._weight() if self.weight else F.lit(1.0)
        classes = sorted(r[0] for r in df.select(quoted(target)).distinct().limit(3).collect()) if "c" in self.params else []
        if "c" in self.params and len(classes) != 2:
            raise ParameterError("Newton histograms of a classifier need two classes")
        y = (F.col(quoted(target)) == F.lit(classes[1])).cast("double") if classes else F.col(quoted(target)).cast("double")
        data = df.withColumn("__y", y)
        if prediction == "model":
            adapter, program = self.adapter_, self.program_
            states = adapter.transform(data)
            p = program.value(program.score({f.name: F.col(f.state_column) for f in adapter.features if f.name in program.features}))
        else:
            adapter = self._adapter()
            states = adapter.fit(data, list(features), key, "__y")
            p = F.lit(data.agg(F.sum(w * F.col("__y")) / F.sum(w)).first()[0])
        if classes:
            p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
        sums = {"g": w * (F.col("__y") - p), "h": w * p * (1 - p) if classes else w}
        states = states.persist()
        try:
            columns = [f.state_column for f in adapter.features]
            singles = HistogramCache.build(states, columns, sums, self._weight(), feature_limit=1).single_gains([1.0])
            gain = {r["feature"]: r["gain"] for r in singles.collect()}
            order = sorted(columns, key=lambda c: (-gain.get(c, 0.0), columns.index(c)))
            made = HistogramCache.build(states, order, sums, self._weight(), pair_features or self.pair_features)
            made = HistogramCache(made.features, stored(made.singles), stored(made.pairs), made.sums)
            return made, float(states.agg(F.sum(w)).first()[0])
        finally:
            states.unpersist()

    def to_config(self) -> dict:
        """The class's name and its parameters, as plain values."""
        return {"estimator": type(self).__name__, "params": dict(self.params)}

    @classmethod
    def from_config(cls, config: dict):
        """The unfitted estimator of :meth:`to_config`."""
        if config["estimator"] != cls.__name__:
            raise ParameterError(f"a configuration of {config['estimator']}, not of {cls.__name__}")
        return cls(**config["params"])

    def save(self, path: str) -> None:
        """Writes the fitted estimator to a folder; see :mod:`stateweave.sources.programs`."""
        from ..sources.programs import save

        save(self, path)

    @classmethod
    def load(cls, path: str):
        from ..sources.programs import load

        out = load(path)
        if not isinstance(out, cls):
            raise ValidationError(f"{path} holds a {type(out).__name__}, not a {cls.__name__}")
        return out

    def names_out(self) -> list[str]:
        return [f.name for f in self.adapter_.features]


def weighted_mean(value, weight: str | None):
    """The mean of a column's values, by a column of weights if one is named."""
    if weight is None:
        return F.avg(value)
    w = F.col(quoted(weight)).cast("double")
    return F.sum(F.when(w > 0, w * value)) / F.sum(F.when((w > 0) & value.isNotNull(), w))


def positive_weight(df: DataFrame, weight: str | None) -> DataFrame:
    """Rows of weight 0 have no part in anything, thresholds and dictionaries included."""
    return df.where(F.col(quoted(weight)) > 0) if weight else df


__all__ = ["Adapter", "Estimator", "ResourcePlan", "physical", "positive_weight", "resource_plan", "weighted_mean"]
