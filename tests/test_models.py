"""Planted signals, exact equivalences and error contracts of the estimators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave import functions as fn
from stateweave.models import FusedRegressor, GeneralizedRegressor, GridSearch, MultiLabelClassifier, MultiOutputRegressor, SharedClassifier, StateClassifier, StateRidgeRegressor
from stateweave.models.inspect import feature_table, interaction_table, structure_table, summary
from stateweave.operators import quantiles, solve
from stateweave.plans.rewrite import optimised
from stateweave.queries import frozen_program
from stateweave.schema import AliasConflictError, ParameterError, ResourceLimitError, SchemaError, ValidationError
from stateweave.sources.programs import load, save, verify


@pytest.fixture(scope="module")
def planted(spark):
    """u0..u2 spread evenly by id; a category; a column with gaps; targets with known structure."""
    i = F.col("id")
    u = [((i * p + 17 * k) % 10007) / 10007 for k, p in enumerate((3571, 7919, 1237))]
    df = spark.range(3000).select(i.alias("key"), *[x.alias(f"u{k}") for k, x in enumerate(u)], F.concat(F.lit("c"), (i % 40).cast("string")).alias("cat"), F.when(i % 7 == 0, None).otherwise(u[2]).alias("gap"))
    flip = (F.col("key") * 6007) % 10 == 0
    df = df.withColumn("main", F.when(flip, (F.col("u0") <= 0.5).cast("int")).otherwise((F.col("u0") > 0.5).cast("int")))
    df = df.withColumn("xor", ((F.col("u0") > 0.5) != (F.col("u1") > 0.5)).cast("int")).withColumn("missing", F.col("gap").isNull().cast("int"))
    df = df.withColumn("three", F.floor(F.col("u0") * 3).cast("int")).withColumn("real", 3 * F.col("u0") + F.when(F.col("u1") > 0.3, 2.0).otherwise(0.0) + (F.col("key") % 40 % 5))
    return df.withColumn("count", F.floor(F.exp(1 + F.col("u0"))).cast("int")).persist()


X = ["u0", "u1", "u2", "cat", "gap"]


def test_classifier_finds_main_effect_and_saves(spark, planted, tmp_path):
    model = StateClassifier(bins=4, max_pairs=1, pair_features=3).fit(planted, X, "main", "key")
    assert model.score(planted, "main") > 0.88
    assert feature_table(spark, model).where("feature = 'num:u0'").count() == 1
    assert structure_table(spark, model).count() == 1 and summary(model)["bytes"] > 0
    save(model.program_, str(tmp_path / "p"))
    verify(str(tmp_path / "p"))
    a = load(str(tmp_path / "p")).transform(planted).select(F.sum("prediction")).first()[0]
    assert a == pytest.approx(model.program_.transform(planted).select(F.sum("prediction")).first()[0], abs=1e-9)
    (tmp_path / "p" / "program.json").write_text("{}")
    with pytest.raises(ValidationError):
        verify(str(tmp_path / "p"))
    shuffled = planted.select("key", *reversed(X))
    assert model.predict(shuffled).count() == 3000
    with pytest.raises(SchemaError):
        model.predict(planted.select("key", "u0"))


def test_classifier_finds_pair(spark, planted):
    model = StateClassifier(bins=4, max_pairs=1, pair_features=3).fit(planted, ["u0", "u1", "u2"], "xor", "key")
    assert model.score(planted, "xor") > 0.95
    pair = interaction_table(spark, model).first()
    assert {pair["left"], pair["right"]} == {"num:u0", "num:u1"}


def test_missing_values_tell(planted):
    model = StateClassifier(bins=4, max_pairs=0).fit(planted, ["u1", "gap"], "missing", "key")
    assert model.score(planted, "missing") > 0.99


def test_multiclass_and_multilabel(planted):
    model = SharedClassifier(bins=8, max_pairs=0, max_features=2).fit(planted, ["u0", "u1"], "three", "key")
    assert model.score(planted, "three") > 0.8
    p = model.predict(planted.limit(5)).select("probabilities").collect()
    assert all(sum(r[0]) == pytest.approx(1) for r in p)
    labels = planted.withColumn("always", F.lit(1))
    out = MultiLabelClassifier(bins=4, max_pairs=0).fit(labels, ["u0", "u1"], ["main", "always"], "key").predict(labels)
    assert out.agg(F.min(F.col("prediction")[1])).first()[0] == 1


def test_regressors(planted):
    ridge = StateRidgeRegressor(bins=8, max_pairs=1).fit(planted, X, "real", "key")
    assert ridge.score(planted, "real") > 0.9
    fused = FusedRegressor(bins=4, thresholds=3, max_pairs=0).fit(planted, X, "real", "key")
    assert fused.score(planted, "real") > 0.85 and fused.branch_ in ("fused", "baseline")
    both = MultiOutputRegressor(bins=8).fit(planted.withColumn("twice", 2 * F.col("real")), X, ["real", "twice"], "key").predict(planted)
    assert both.agg(F.max(F.abs(2 * F.col("prediction_real") - F.col("prediction_twice")))).first()[0] < 1e-6


def test_generalized(planted):
    data = planted.withColumn("exposure", 1.0 + F.col("u1"))
    model = GeneralizedRegressor(loss="poisson", exposure="exposure", bins=4, max_pairs=0).fit(data, ["u0", "u2"], "count", "key")
    one = model.predict(data).agg(F.sum("prediction")).first()[0]
    two = model.predict(data.withColumn("exposure", 2 * F.col("exposure"))).agg(F.sum("prediction")).first()[0]
    assert two == pytest.approx(2 * one)
    q = GeneralizedRegressor(loss="quantile", quantiles=(0.1, 0.9), bins=4, max_pairs=0).fit(planted, ["u0"], "real", "key").predict(planted)
    share = q.agg(F.avg((F.col("real") < F.col("prediction")[1]).cast("double")), F.min(F.col("prediction")[1] - F.col("prediction")[0])).first()
    assert 0.85 < share[0] < 0.95 and share[1] >= 0
    with pytest.raises(ValidationError):
        GeneralizedRegressor(loss="gamma").fit(planted.withColumn("z", F.lit(0.0)), ["u0"], "z", "key")


def test_search(planted):
    search = GridSearch(StateRidgeRegressor(max_pairs=0, max_features=2), {"bins": [2, 8]}, folds=2).fit(planted, ["u0", "u1"], "real", "key")
    assert search.best_params_ == {"bins": 8}
    with pytest.raises(ResourceLimitError):
        GridSearch(StateRidgeRegressor(), {"bins": list(range(2, 60))}).fit(planted, ["u0"], "real", "key")


def test_parameters():
    with pytest.raises(AliasConflictError):
        StateRidgeRegressor(max_features=3, feature_budget=4)
    with pytest.raises(ParameterError):
        StateRidgeRegressor(nothing=1)
    assert StateRidgeRegressor(feature_budget=4).max_features == 4


def test_weights_are_repetition(spark):
    rows = [(float(v), w) for v, w in zip(np.random.default_rng(0).normal(size=41), [0, 1, 2, 3, 4] * 9, strict=False)]
    df = spark.createDataFrame(rows, "v double, w int")
    p = np.linspace(0, 1, 23).tolist()
    assert quantiles.weighted_quantiles(df, "v", "w", p) == pytest.approx(np.quantile(np.repeat([r[0] for r in rows], [r[1] for r in rows]), p).tolist())
    values = df.select(F.col("v").alias("v0"), (F.col("v") * 2).alias("v1"), F.col("w").cast("double").alias("w"))
    plain = quantiles._narrowed(values.withColumn("w", F.lit(1.0)), ["a", "b"], p, False)
    assert plain["a"] == pytest.approx(np.quantile([r[0] for r in rows], p).tolist()) and plain["b"] == pytest.approx([2 * x for x in plain["a"]])
    assert quantiles._narrowed(values.where("w > 0"), ["a", "b"], p, False)["a"] == pytest.approx(np.quantile(np.repeat([r[0] for r in rows], [r[1] for r in rows]), p).tolist())
    real = df.withColumn("w", F.col("w") * 0.7)
    order = sorted((v, 0.7 * w) for v, w in rows if w)
    total = np.cumsum([w for _, w in order])
    middle = np.interp(np.array(p) * total[-1], total - np.array([w for _, w in order]) / 2, [v for v, _ in order])
    assert quantiles.weighted_quantiles(real, "v", "w", p) == pytest.approx(middle.tolist())
    assert quantiles._narrowed(values.limit(0), ["a", "b"], p, False) == {"a": [], "b": []}
    with pytest.raises(ValidationError):
        quantiles.check_weights(df.withColumn("w", -F.col("w")), "w")


def test_logistic_penalises_the_constant(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 3, 500), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y, strict=True)], "s int, y int")
    design = solve.Design([("s", 3)])
    for local in (10_000, 0):
        w = solve.logistic_l2(solve.Rows(df, ["s"], ["y"], driver_rows=local), design, "y", 0.7)
        x = np.column_stack([np.ones(500), s == 1, s == 2]).astype(float)
        assert np.abs(w + 0.7 * x.T @ (1 / (1 + np.exp(-x @ w)) - y)).max() < 1e-5


def test_rewrite_is_exact():
    from stateweave.plans.program import Program

    a = frozen_program()
    b = optimised(a)
    assert "num:day" not in b.features and len(b.pairs) == 1 and b.size_bytes() < a.size_bytes()
    assert Program.from_json(b.to_json()) == b
    assert a.quantised().error_bound() < 1e-4


def test_streaming(spark, planted, tmp_path):
    from stateweave.streaming import score_stream

    planted.select("key", "u0", "u1").coalesce(1).write.parquet(str(tmp_path / "in"))
    program = StateClassifier(bins=4, max_pairs=0).fit(planted, ["u0", "u1"], "main", "key").program_
    stream = spark.readStream.schema("key bigint, u0 double, u1 double").parquet(str(tmp_path / "in"))
    score_stream(stream, program, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000


def test_small_functions():
    assert fn.residual_map([0, 0, 1, 1, 1]) == [0, 1, 0, 2, 3]
    assert fn.coarse_map(16, 4) == [s // 4 for s in range(16)]
    assert fn.coarse_map(5, 4, nominal=True) == [0] * 5
    assert solve.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert quantiles.newton_thresholds([(float(i), float(i > 4), 1.0) for i in range(10)], (2,))[2] == [5.0]
