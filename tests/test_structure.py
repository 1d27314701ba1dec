"""Blocks, refinement, class corrections, weights, embeddings and storage, on planted signals and against plain NumPy."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave import functions as fn
from stateweave.models import BlockClassifier, FusedRegressor, GeneralizedRegressor, MultiLabelClassifier, MultiOutputRegressor, Refinement, ResolutionRegressor, SharedClassifier, StateClassifier, StateRidgeRegressor
from stateweave.models.base import Adapter
from stateweave.operators import adapt, cache, deltas, refine, solve
from stateweave.plans.program import Program
from stateweave.schema import ParameterError, ValidationError
from stateweave.sources.programs import load, save


@pytest.fixture(scope="module")
def planted(spark):
    i = F.col("id")
    u = [((i * p + 17 * k) % 10007) / 10007 for k, p in enumerate((3571, 7919, 1237, 6007))]
    df = spark.range(4000).select(i.alias("key"), *[x.alias(f"u{k}") for k, x in enumerate(u)], F.concat(F.lit("c"), (i % 30).cast("string")).alias("cat"))
    inside = F.when(F.col("u0") > 0.75, (F.col("u1") > 0.5).cast("double")).otherwise(0.5)
    df = df.withColumn("gated", (F.rand(3) < 0.05 + 0.9 * inside).cast("int"))
    fine = F.floor(F.col("u2") * 16).cast("int")
    df = df.withColumn("bumpy", (F.rand(4) < F.when(fine % 2 == 0, 0.2).otherwise(0.8)).cast("int"))
    parity = (F.floor(F.col("u0") * 2) + F.floor(F.col("u1") * 2) + F.floor(F.col("u2") * 2)) % 2
    df = df.withColumn("triple", (F.rand(5) < 0.2 + 0.6 * parity).cast("int"))
    df = df.withColumn("three", F.floor(F.col("u0") * 3).cast("int")).withColumn("real", 3 * F.col("u0") + (F.col("key") % 30 % 5) + F.when(F.col("u1") > 0.3, 2.0).otherwise(0.0))
    return spark.createDataFrame(df.collect(), df.schema).repartition(4).persist()


@pytest.mark.parametrize("selection", ["holdout", "crossfit"])
def test_blocks_are_found_inside_a_gate(planted, selection):
    model = BlockClassifier(bins=4, max_pairs=0, pair_features=3, selection=selection, c=0.5).fit(planted, ["u0", "u1", "u2"], "gated", "key")
    found = model.diagnostics_[0]["blocks"]
    assert ("num:u0", 3, "num:u1") in found
    plain = StateClassifier(bins=4, max_pairs=0, c=0.5).fit(planted, ["u0", "u1", "u2"], "gated", "key")
    loss = lambda m: m.program_.transform(planted).agg(F.avg(-F.log(F.when(F.col("gated") == 1, F.col("prediction")).otherwise(1 - F.col("prediction"))))).first()[0]
    assert loss(model) < loss(plain) - 0.02
    with pytest.raises(ParameterError):
        BlockClassifier(blocks="other").fit(planted, ["u0"], "gated", "key")
    with pytest.raises(ValidationError):
        BlockClassifier().fit(planted, ["u0"], "three", "key")


def test_no_blocks_without_a_signal(planted):
    model = BlockClassifier(bins=4, max_pairs=0, pair_features=3, c=0.5).fit(planted, ["u1", "u2", "u3"], "gated", "key")
    assert model.diagnostics_[0]["blocks"] == []


def test_refinement(planted):
    constant = Program({}, 0.0, link="logit")
    finer = Refinement(["u1", "u2"]).fit(planted, constant, "bumpy", "key")
    assert finer.accepted_ and any("u2" in b for b in finer.bases_) and not any(finer.violations_.values())
    scored = finer.program_.transform(planted)
    assert scored.agg(F.avg(((F.col("prediction") > 0.5).cast("int") == F.col("bumpy")).cast("double"))).first()[0] > 0.75
    triple = Refinement(["u0", "u1", "u2", "u3"], alpha=1e-6).fit(planted, constant, "triple", "key")
    assert triple.accepted_ and len(triple.program_.cubes) == 1 and {"u0", "u1", "u2"} == {triple.program_.features[c].column for c in triple.program_.cubes[0][:3]}
    none = Refinement(["u3"]).fit(planted, constant, "bumpy", "key")
    assert not none.accepted_ and none.program_ is constant


def test_bases_against_least_squares():
    rng = np.random.default_rng(0)
    h, g = rng.gamma(2.0, size=64), rng.normal(size=64)
    for nuisance in (refine.pair_design(4), refine.parent_design(16, 64)):
        b = refine.quotient_basis("b", ("a",), (64,), nuisance, g, h)
        assert np.abs(b.table.T @ (h[:, None] * b.table) - np.eye(b.df)).max() < 1e-8
        assert np.abs(nuisance.T @ (h[:, None] * b.table)).max() < 1e-8
        y = -g / h  # the gain is half of what a weighted fit of all states explains beyond the nuisance
        left = y - nuisance @ np.linalg.lstsq(nuisance * np.sqrt(h)[:, None], y * np.sqrt(h), rcond=None)[0]
        assert b.gain == pytest.approx(0.5 * float(h @ left**2)) and b.df == 64 - np.linalg.matrix_rank(nuisance)
        assert refine.spill(b.table @ np.ones(b.df), h, nuisance) < 1e-12
    assert refine.pair_design(4).shape == (64, 37)
    with pytest.raises(ValueError, match="multiple"):
        refine.parent_design(3, 8)


def test_cross_gram_and_selection(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, 3000), rng.integers(0, 4, 3000)
    p = 1 / (1 + np.exp(-(0.8 * (a == 1) - 0.8 * (a == 3))))
    y = rng.random(3000) < p
    df = spark.createDataFrame([(int(i), int(j), int(i), float(v)) for i, j, v in zip(a, b, y, strict=True)], "a int, b int, again int, y double")
    g, h = F.lit(0.5) - F.col("y"), F.lit(0.25)
    sums = refine.sums_by_state(df, ["a", "b", "again"], [4, 4, 4], g, h)
    bases = [refine.quotient_basis(c, (c,), (4,), np.ones((4, 1)), sums[c][1], sums[c][2]) for c in ("a", "b", "again")]
    model = refine.JointModel.of(df, bases, h)
    rows = [bases[i].table[x] for i, x in enumerate((a, b, a))]
    want = np.column_stack(rows).T @ np.column_stack(rows) * 0.25
    assert np.abs(model.k - want).max() < 1e-8
    assert model.select() == [0]  # the copy adds nothing, b tells nothing
    assert model.correlations(0, 2) == pytest.approx(1) and model.without(0).adds(2) == (0.0, 0)
    both = np.column_stack(rows[:2])  # what a basis adds beside another is what both explain less what one does
    gain = lambda x: 0.5 * float(model.t[: x.shape[1]] @ np.linalg.lstsq(x.T @ x * 0.25, model.t[: x.shape[1]], rcond=None)[0])
    assert model.without(0).adds(1)[0] == pytest.approx(gain(both) - gain(rows[0]))
    tables = model.part([0]).tables(l2=20.0, rate=1.0)
    beta = np.linalg.solve(np.eye(3) + 20 * bases[0].table.T @ bases[0].table, model.t[:3])
    assert np.allclose(tables[0], bases[0].table @ beta) and tables[0][1] > 0 > tables[0][3]


def test_best_triad(spark, planted):
    states = planted.select("triple", *[F.floor(F.col(c) * 4).cast("int").alias(c) for c in ("u0", "u1", "u2", "u3")])
    best = refine.best_triad(states, ["u0", "u1", "u2", "u3"], F.lit(0.5) - F.col("triple"), F.lit(0.25))
    assert set(best.columns) == {"u0", "u1", "u2"}
    data = states.toPandas()
    gains = []
    for c in combinations(["u0", "u1", "u2", "u3"], 3):
        code = (data[c[0]] * 4 + data[c[1]]) * 4 + data[c[2]]
        n = np.bincount(code, minlength=64)
        b = refine.quotient_basis("x", c, (4, 4, 4), refine.pair_design(4), np.bincount(code, 0.5 - data["triple"], 64), 0.25 * n, n >= 4)
        gains.append(b.gain)
    assert best.gain == pytest.approx(max(gains))


def test_weight_two_is_two_rows(spark, planted):
    """Every estimator gives the same model for weights and for rows that are repeated."""
    weighted = planted.withColumn("w", (F.col("key") % 3).cast("double")).persist()
    repeated = weighted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).where("copy <= w").drop("copy", "w")
    x, small = ["u0", "u1", "cat"], {"bins": 4, "max_pairs": 1, "pair_features": 3}
    labels = lambda d: d.withColumn("one", F.col("gated")).withColumn("two", F.col("bumpy"))
    cases = [
        (StateClassifier, {"calibration": "affine", "c": 0.5}, "gated", "probability"),
        (BlockClassifier, {"c": 0.5, "max_blocks": 2}, "gated", "probability"),
        (SharedClassifier, {"class_deltas": 3, "c": 0.5}, "three", "probabilities"),
        (MultiLabelClassifier, {"c": 0.5}, ["one", "two"], "probabilities"),
        (StateRidgeRegressor, {"alpha": 1.0}, "real", "prediction"),
        (FusedRegressor, {"thresholds": 3, "alpha": 1.0}, "real", "prediction"),
        (GeneralizedRegressor, {"loss": "huber"}, "real", "prediction"),
        (MultiOutputRegressor, {}, ["real", "u2"], "prediction_real"),
        (ResolutionRegressor, {"levels": (4, 8), "alpha": (1.0,)}, "real", "prediction"),
    ]
    for cls, options, target, output in cases:
        x = [c for c in x if c != "cat"] if cls is ResolutionRegressor else x
        a = cls(weight="w", **small, **options).fit(labels(weighted), x, target, "key")
        b = cls(**small, **options).fit(labels(repeated), x, target, "key")
        one, two = (m.predict(planted.select("key", *x)).orderBy("key").select(output).toPandas()[output].tolist() for m in (a, b))
        assert np.abs(np.array([np.ravel(v) for v in one]) - np.array([np.ravel(v) for v in two])).max() < 2e-5, cls.__name__


def test_estimators_are_stored(spark, planted, tmp_path):
    x, rows = ["u0", "u1", "cat"], planted.select("key", "u0", "u1", "cat")
    for model, output in [
        (StateClassifier(bins=4, max_pairs=1).fit(planted, x, "gated", "key"), "probability"),
        (FusedRegressor(bins=4, thresholds=3, max_pairs=0).fit(planted, x, "real", "key"), "prediction"),
        (GeneralizedRegressor(loss="quantile", quantiles=(0.2, 0.8), bins=4).fit(planted, ["u0"], "real", "key"), "prediction"),
    ]:
        path = str(tmp_path / type(model).__name__)
        model.save(path)
        again = type(model).load(path)
        assert model.predict(rows.select("key", *model.columns_)).orderBy("key").select(output).collect() == again.predict(rows.select("key", *model.columns_)).orderBy("key").select(output).collect()
        assert type(model).from_config(model.to_config()).get_params() == model.get_params() == again.get_params()
    adapter = Adapter(bins=4)
    states = adapter.fit(planted, x, "key", "gated")
    save(adapter, str(tmp_path / "adapter"))
    back = load(str(tmp_path / "adapter"))
    assert back == adapter and back.size_bytes() > 0
    assert back.transform(rows).columns[len(rows.columns) :] == [f.state_column for f in adapter.features] and set(states.columns) >= {f.state_column for f in adapter.features}
    with pytest.raises(ValidationError):
        StateRidgeRegressor.load(str(tmp_path / "StateClassifier"))


def test_class_deltas(spark):
    rng = np.random.default_rng(3)
    s, z = rng.integers(0, 3, 2000), rng.normal(size=(2000, 3))
    true = z.copy()
    true[s == 1, 2] += 1.5
    y = (np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)).cumsum(axis=1)
    y = (rng.random(2000)[:, None] > y).sum(axis=1)
    df = spark.createDataFrame([(int(a), int(b), *map(float, v)) for a, b, v in zip(s, y, z, strict=True)], "s int, y int, z0 double, z1 double, z2 double")
    rows = solve.Rows(df, ["s", "z0", "z1", "z2"], ["y"])
    (x,) = deltas.fit_deltas(rows, [("s", 1, 2)], ["z0", "z1", "z2"], "y", l2=5.0)

    def objective(v):
        w = z[s == 1].copy()
        w[:, 2] += v
        return -(w[np.arange(len(w)), y[s == 1]] - np.log(np.exp(w).sum(axis=1))).sum() + 2.5 * v * v

    assert objective(x) <= min(objective(x + e) for e in (-0.01, 0.01)) and 0.8 < x < 2
    assert deltas.prefixes(12) == [0, 4, 8, 12] and deltas.prefixes(1) == [0, 1] and deltas.prefixes(2) == [0, 1, 2] and deltas.prefixes(0) == [0]


def test_threshold_head_against_its_objective(spark):
    rng = np.random.default_rng(4)
    s, v = rng.integers(0, 3, 600), rng.normal(size=600)
    cuts = [-1.0, -0.3, 0.2, 0.9]
    v = v + 0.8 * (s == 2)
    df = spark.createDataFrame([(int(a), *[int(x > c) for c in cuts]) for a, x in zip(s, v, strict=True)], "s int, b0 int, b1 int, b2 int, b3 int")
    design, labels, basis = solve.Design([("s", 3)]), ["b0", "b1", "b2", "b3"], solve.spline_basis(cuts, 1)
    x = np.column_stack([s == 1, s == 2]).astype(float)
    truth = (v[:, None] > np.array(cuts)).astype(float)
    for local in (10_000, 0):
        w = solve.threshold_head(solve.Rows(df, ["s"], labels, driver_rows=local), design, labels, basis, 2.0)
        coefficients = np.linalg.lstsq(basis, w[1:].T, rcond=None)[0].T
        assert np.allclose(coefficients @ basis.T, w[1:])

        def objective(c, b):
            z = x @ c @ basis.T + b
            return (np.logaddexp(0, z) - truth * z).sum() + (c**2).sum()

        best = objective(coefficients, w[0])
        for _ in range(30):
            assert best <= objective(coefficients + 0.02 * rng.normal(size=coefficients.shape), w[0] + 0.02 * rng.normal(size=4)) + 1e-9


def test_huber_scale_is_joint(spark):
    rng = np.random.default_rng(5)
    s = rng.integers(0, 2, 800)
    y = 2.0 * s + rng.normal(size=800) * 0.5
    y[:40] += 50
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(s, y, strict=True)], "s int, y double")
    w, scale = solve.huber_regression(solve.Rows(df, ["s"], ["y"]), solve.Design([("s", 2)]), "y", alpha=1e-4, scale=float(y.std()))
    assert 0.35 < scale < 0.75 and abs(w[1] - 2) < 0.15 and abs(w[0]) < 0.3
    r = np.abs(w[0] + w[1] * s - y)
    inside = r <= 1.35 * scale
    assert len(y) == pytest.approx((r[inside] ** 2).sum() / scale**2 + (~inside).sum() * 1.35**2, rel=1e-2)


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 1500)
    x = rng.normal(size=(1500, 4)) * 0.3
    x[:, 0] += np.where(y == 1, np.where(rng.random(1500) < 0.5, 2.0, -2.0), 0.0)  # two clumps around another: no linear split
    df = spark.createDataFrame([(i, [float(v) for v in row], int(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "key long, e array<double>, y int")
    mean, directions, values = adapt.principal_directions(df, "e", 4)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(values, want) and np.allclose(mean, x.mean(axis=0)) and np.allclose(directions @ directions.T, np.eye(4))
    got = np.array([r[0] for r in df.orderBy("key").select(adapt.projected("e", mean, directions)).collect()])
    assert np.allclose(got, (x - mean) @ directions.T)
    w, b = adapt.discriminant_direction(df, "e", "y", 0.1)
    m = [x[y == c].mean(axis=0) for c in (0, 1)]
    cov = sum((x[y == c] - m[c]).T @ (x[y == c] - m[c]) for c in (0, 1)) / 1500
    cov = 0.9 * cov + 0.1 * np.trace(cov) / 4 * np.eye(4)
    assert np.allclose(w, np.linalg.solve(cov, m[1] - m[0]))
    scores = {kind: StateClassifier(embedding=kind, max_pairs=0).fit(df, ["e"], "y", "key").score(df, "y") for kind in ("basic", "prototype")}
    assert min(scores.values()) > 0.9


@pytest.mark.parametrize("block", [500, 100_000_000])
def test_knn_in_blocks(spark, block):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(120, 3)).round(2), rng.integers(0, 2, 120)
    df = spark.createDataFrame([(i, row.tolist(), int(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    got = {r.id: r.probability for r in adapt.knn_probability(df, "id", "x", "y", F.col("id") % 4 == 0, [3, 7], F.col("id") % 2, block).collect()}
    for i in range(0, 120, 4):
        d = ((x - x[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(120), d.round(9))) if j % 2 != i % 2]
        for k, p in zip((3, 7), got[i], strict=True):
            w = 1 / (np.sqrt(d[order[:k]].round(9)) + 1e-9)
            assert p == pytest.approx(float(w @ y[order[:k]] / w.sum()))


def test_nested_codes_tell_the_finest_state(spark):
    df = spark.range(256).select((F.col("id") % 16).cast("int").alias("a"), F.floor(F.col("id") / 16).cast("int").alias("b"))
    codes = fn.nested_codes({"a": ("a", 16), "b": ("b", 12)}, [("a", "b")], fine_pairs=True)
    names = [c for c in codes if c.startswith("a_") and "_x_" not in c]
    assert df.select(*[codes[c].alias(c) for c in names]).distinct().count() == 16
    pair = [c for c in codes if "_x_" in c]
    assert len(pair) == 3 and df.where("b < 12").select(*[codes[c].alias(c) for c in pair]).distinct().count() == 16 * 12
    assert df.select(codes["a_8"].alias("r")).where("r = 0").count() == 128  # the first child of each parent


def test_resolutions_together(planted):
    model = ResolutionRegressor(levels=(4, 8), max_pairs=1).fit(planted.withColumn("z", 4 * F.col("u0") + (F.col("u1") > 0.3).cast("int")), ["u0", "u1", "u2"], "z", "key")
    assert model.score(planted.withColumn("z", 4 * F.col("u0") + (F.col("u1") > 0.3).cast("int")), "z") > 0.95


def test_cache_is_stored(spark, planted, tmp_path):
    states = planted.select("gated", *[F.floor(F.col(c) * 4).cast("int").alias(c) for c in ("u0", "u1", "u2")])
    made = cache.HistogramCache.newton(states, ["u0", "u1", "u2"], "gated", F.lit(0.5))
    made.save(str(tmp_path / "cache"))
    again = cache.HistogramCache.load(spark, str(tmp_path / "cache"))
    assert again.features == made.features and again.sums == ["g", "h"]
    assert made.top_pairs(5.0, 2).orderBy("rank").collect() == again.top_pairs(5.0, 2).orderBy("rank").collect()
    assert made.top_pairs(5.0, 1).first()["f0"] == "u0" and math.isfinite(made.top_pairs(5.0, 1).first()["gain"])


@pytest.mark.parametrize("how", ["newton", "residual_newton", "newton_prefilter_mi", "diversified"])
def test_pair_rankings(planted, how):
    model = StateClassifier(bins=4, max_pairs=1, pair_features=3, pair_ranking=how, c=0.5).fit(planted, ["u0", "u1", "u2"], "gated", "key")
    assert set(model.diagnostics_[0]["pairs"][0] if model.diagnostics_[0]["pairs"] else ("num:u0", "num:u1")) == {"num:u0", "num:u1"}
    with pytest.raises(ParameterError):
        StateClassifier(pair_ranking="best").fit(planted, ["u0", "u1"], "gated", "key")
