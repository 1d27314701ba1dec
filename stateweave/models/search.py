"""Search over parameters by cross-validation on folds of the key."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keys import hashed_fold
from ..operators.cache import HistogramCache
from ..schema import ParameterError, ResourceLimitError, quoted

#: Parameters that change which states rows have; candidates that agree in these share their cells.
REPRESENTATION = ("bins", "embedding", "weight", "colsample", "seed")


def discounted(gains: list[float], most: int) -> float:
    """The best ``most`` positive gains, each divided by the root of its rank."""
    best = sorted((g for g in gains if g > 0), reverse=True)[:most]
    return float(sum(g / np.sqrt(i) for i, g in enumerate(best, 1)))


class GridSearch:
    """Fits every combination on every fold (a candidate's score is the mean over folds) and refits the best.

    ``prefilter=True``: only the ``keep`` candidates are fitted whose structure promises most by histograms alone.  For
    each representation (see ``REPRESENTATION``) and fold the cells of states and pairs are summed once; a candidate's
    promise is the discounted sum of its best Newton gains of single features (``max_features``) and of pairs beyond
    their features (``max_pairs`` among the best ``pair_features``) at its penalty, a row, over all folds.  ``proxy``: a
    cheap function (params) -> number instead.  ``max_fits`` guards the number of fits.  Folds are cached while the
    search runs.
    """

    def __init__(self, estimator, grid: dict[str, list], folds: int = 3, proxy=None, keep: int = 8, max_fits: int = 128, seed: int = 1, prefilter: bool = False):
        self.estimator, self.grid, self.folds, self.proxy, self.keep, self.max_fits, self.seed, self.prefilter = estimator, grid, folds, proxy, keep, max_fits, seed, prefilter

    def fit(self, df: DataFrame, features: list[str], target: str, key: str) -> GridSearch:
        every = [dict(zip(self.grid, v, strict=True)) for v in product(*self.grid.values())]
        if (self.proxy or self.prefilter) and len(every) > self.keep and self.keep * self.folds > self.max_fits or not (self.proxy or self.prefilter) and len(every) * self.folds > self.max_fits:
            raise ResourceLimitError(f"{min(self.keep, len(every)) * self.folds} fits; {self.max_fits} allowed")
        data = df.withColumn("__cv", hashed_fold(F.col(quoted(key)), self.folds, self.seed)).persist()
        try:
            self.promises_ = self._promises(every, data, features, target, key) if self.prefilter else [self.proxy(p) for p in every] if self.proxy else [0.0] * len(every)
            order = sorted(range(len(every)), key=lambda i: (-self.promises_[i], i))
            chosen = [every[i] for i in (order[: self.keep] if self.proxy or self.prefilter else order)]
            self.results_ = []
            for p in chosen:
                scores = []
                for k in range(self.folds):
                    model = self.estimator.clone().set_params(**p).fit(data.where(f"__cv <> {k}").drop("__cv"), features, target, key)
                    scores.append(model.score(data.where(f"__cv = {k}").drop("__cv"), target))
                self.results_.append({"params": p, "scores": scores, "mean": sum(scores) / len(scores)})
        finally:
            data.unpersist()
        self.best_params_ = max(self.results_, key=lambda r: r["mean"])["params"]
        self.avoided_ = len(every) - len(chosen)
        self.best_ = self.estimator.clone().set_params(**self.best_params_).fit(df, features, target, key)
        return self

    def _promises(self, every: list[dict], data: DataFrame, features: list[str], target: str, key: str) -> list[float]:
        models = [self.estimator.clone().set_params(**p) for p in every]
        groups: dict[tuple, list[int]] = {}
        for i, m in enumerate(models):
            groups.setdefault(tuple((c, m.params[c]) for c in REPRESENTATION if c in m.params), []).append(i)
        out = [0.0] * len(every)
        for members in groups.values():
            penalties = sorted({penalty(models[i]) for i in members})
            for k in range(self.folds):
                cache, n = models[members[0]].newton_cache(data.where(f"__cv <> {k}").drop("__cv"), features, target, key, pair_features=max(models[i].pair_features for i in members))
                cache = cache.persist()
                try:
                    singles, pairs = cache.gains(penalties)
                finally:
                    cache.unpersist()
                for i in members:
                    m, l2 = models[i], penalty(models[i])
                    best = sorted(singles[l2], key=lambda f: (-singles[l2][f], cache.features.index(f)))
                    near = set(best[: min(m.max_features, m.pair_features)])
                    promise = discounted([singles[l2][f] for f in best], m.max_features) + discounted([x for (a, b), x in pairs[l2].items() if a in near and b in near], m.max_pairs)
                    out[i] += promise / max(n, 1) / self.folds
        return out

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.best_.predict(df, output)


def penalty(model) -> float:
    """The weakest L2 penalty that an estimator tries, on sums over rows."""
    if "c" in model.params:
        return 1.0 / max(model.c if isinstance(model.c, (tuple, list)) else (model.c,))
    if "alpha" in model.params:
        return float(min(model.alpha if isinstance(model.alpha, (tuple, list)) else (model.alpha,)))
    raise ParameterError(f"{type(model).__name__} has no penalty to rank candidates by")


__all__ = ["GridSearch", "HistogramCache", "discounted", "penalty"]
