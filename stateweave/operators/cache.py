"""Histograms of states and pairs, computed once, stored, and ranked again under other penalties without the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rank, stats


@dataclass
class HistogramCache:
    """Cells of single features (feature, state) and of pairs (f0, f1, s0, s1) with ``n`` and the named sums."""

    features: list[str]
    singles: DataFrame
    pairs: DataFrame
    sums: list[str]

    @staticmethod
    def build(df: DataFrame, features: list[str], sums: dict[str, Column], weight: Column | None = None, feature_limit: int | None = None) -> HistogramCache:
        """Two aggregations over the rows; ``feature_limit``: pairs of the first so many features only."""
        chosen = features[:feature_limit] if feature_limit else features
        pairs, rows = stats.pairs_of(chosen), df
        if not pairs:
            pairs, rows = [(features[0], features[0])], df.limit(0)
        return HistogramCache(list(features), stats.state_cells(df, features, sums=sums, weight=weight), stats.tuple_cells(rows, pairs, sums=sums, weight=weight), list(sums))

    @staticmethod
    def newton(df: DataFrame, features: list[str], target: str, probability: Column, weight: Column | None = None, feature_limit: int | None = None, clip: float = 1e-6) -> HistogramCache:
        """Gradients (truth less prediction) and Hessians of the log loss at a predicted probability."""
        p = F.greatest(F.least(probability, F.lit(1 - clip)), F.lit(clip))
        w = weight if weight is not None else F.lit(1.0)
        return HistogramCache.build(df, features, {"g": w * (F.col(target) - p), "h": w * p * (1 - p)}, weight, feature_limit)

    def persist(self) -> HistogramCache:
        self.singles, self.pairs = self.singles.persist(), self.pairs.persist()
        return self

    def unpersist(self) -> None:
        self.singles.unpersist()
        self.pairs.unpersist()

    def single_gains(self, l2: list[float]) -> DataFrame:
        """l2, feature, gain: for every penalty from the same cells."""
        swept = self.singles.withColumn("l2", F.explode(F.array(*map(F.lit, map(float, l2)))))
        return swept.groupBy("l2", "feature").agg((F.sum(F.col("g") ** 2 / (F.col("h") + F.col("l2"))) / 2).alias("gain"))

    def gains(self, l2: list[float]) -> tuple[dict[float, dict[str, float]], dict[float, dict[tuple[str, str], float]]]:
        """Gains of features and excesses of pairs under each penalty (a row for each feature and pair reaches the driver)."""
        one: dict = {x: {} for x in l2}
        two: dict = {x: {} for x in l2}
        for r in self.single_gains(l2).collect():
            one[r["l2"]][r["feature"]] = r["gain"]
        for r in self.pair_gains(l2).collect():
            two[r["l2"]][r["f0"], r["f1"]] = r["excess"]
        return one, two

    def pair_gains(self, l2: list[float]) -> DataFrame:
        """l2, f0, f1, gain, excess over the better of the two features: for every penalty from the same cells."""
        swept = lambda cells: cells.withColumn("l2", F.explode(F.array(*map(F.lit, map(float, l2)))))
        gain = (F.sum(F.col("g") ** 2 / (F.col("h") + F.col("l2"))) / 2).alias("gain")
        one = self.single_gains(l2)
        two = swept(self.pairs).groupBy("l2", "f0", "f1").agg(gain)
        side = lambda f, name: F.broadcast(one.select("l2", F.col("feature").alias(f), F.col("gain").alias(name)))
        return two.join(side("f0", "a"), ["l2", "f0"]).join(side("f1", "b"), ["l2", "f1"]).select("l2", "f0", "f1", "gain", (F.col("gain") - F.greatest("a", "b")).alias("excess"))

    def top_pairs(self, l2: float, k: int) -> DataFrame:
        """The best pairs under one penalty."""
        return rank.top_pairs(self.pair_gains([l2]).drop("l2"), self.features, "excess", k, "gain")

    def save(self, path: str) -> None:
        """Parquet tables under ``path`` (any file system that Spark writes to)."""
        order = self.singles.sparkSession.createDataFrame([(i, f) for i, f in enumerate(self.features)], "i int, feature string")
        for name, df in (("features", order), ("singles", self.singles), ("pairs", self.pairs)):
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> HistogramCache:
        read = lambda name: spark.read.parquet(f"{path.rstrip('/')}/{name}")
        features = [r["feature"] for r in read("features").orderBy("i").collect()]
        singles = read("singles")
        return HistogramCache(features, singles, read("pairs"), [c for c in singles.columns if c not in ("feature", "state", "n")])
