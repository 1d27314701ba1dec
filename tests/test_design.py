"""Designs by cells against dense matrices, nested designs, calibration, rankings in turn, embeddings out of fold, search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave import functions as fn
from stateweave.models import GridSearch, StateClassifier
from stateweave.models.block import block_columns, in_turn
from stateweave.models.classify import design_of, level_maps, nested_table, program_of
from stateweave.operators import adapt, solve
from stateweave.plans.program import Feature


def dense(design, data, n):
    """The matrix that the library never makes."""
    out = [np.ones(n)]
    for c, k in design.mains:
        table = design.shapes.get(c, np.eye(k)[:, 1:])
        out += list(table[data[c].astype(int)].T)
    for a, ka, b, kb in design.pairs:
        table = design.shapes.get((a, b), np.eye(ka * kb)[:, 1:])
        out += list(table[data[a].astype(int) * kb + data[b].astype(int)].T)
    out += [(data[c] - m) / s for c, m, s in design.linear]
    for gate, s, target, centres, scales in design.blocks:
        out += [(data[gate] == s) * ((data[target] == k) - c) * x for k, (c, x) in enumerate(zip(centres, scales, strict=True))]
    return np.column_stack(out)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 4000
    data = {"a": rng.integers(0, 4, n), "b": rng.integers(0, 3, n), "c": rng.integers(0, 16, n), "x": rng.normal(size=n), "w": rng.gamma(1.0, size=n), "f": rng.integers(0, 3, n)}
    eta = 0.8 * (data["a"] == 2) - 0.6 * (data["b"] == 1) * (data["a"] == 1) + 0.1 * data["c"] / 4 + 0.3 * data["x"]
    data["y"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    data["m"] = rng.poisson(np.exp(0.3 * eta))
    df = spark.createDataFrame([tuple(float(v[i]) if v.dtype.kind == "f" else int(v[i]) for v in data.values()) for i in range(n)], ", ".join(f"{k} {'double' if v.dtype.kind == 'f' else 'int'}" for k, v in data.items()))
    return df.persist(), {k: v.astype(float) for k, v in data.items()}, n


@pytest.fixture(scope="module")
def planted(spark):
    """Three even columns; a main effect, and one that holds inside a state of another column only."""
    rng = np.random.default_rng(11)
    u = rng.random((3000, 3))
    main = (rng.random(3000) < np.where(u[:, 0] > 0.5, 0.9, 0.1)).astype(int)
    gated = (rng.random(3000) < np.where(u[:, 0] > 0.75, 0.05 + 0.9 * (u[:, 1] > 0.5), 0.5)).astype(int)
    return spark.createDataFrame([(i, *map(float, u[i]), int(main[i]), int(gated[i])) for i in range(3000)], "key long, u0 double, u1 double, u2 double, main int, gated int").repartition(4).persist()


DESIGN = solve.Design([("a", 4), ("c", 16)], [("a", 4, "b", 3)], [("x", 0.1, 1.2)], [("b", 1, "a", [0.2, 0.3, 0.1], [1.0, 0.5, 0.0])], {"c": nested_table(level_maps(16, (4, 8, 16), False))})


@pytest.mark.parametrize("driver_rows", [10**6, 0])
def test_sums_and_fits_equal_dense_ones(table, driver_rows):
    df, data, n = table
    rows = solve.Rows(df, DESIGN.columns, ["y", "m"], "w", driver_rows, extra=["f"])
    assert (rows.local is None) == (driver_rows == 0)
    x, w = dense(DESIGN, data, n), data["w"]
    one, two = solve.grams(rows, DESIGN, ["y", "m"], "f", (0, 2))
    on, y = data["f"] == 2, np.column_stack([data["y"], data["m"]])
    assert np.allclose(two[0], (x[on] * w[on, None]).T @ x[on]) and np.allclose(two[1], (x[on] * w[on, None]).T @ y[on]) and np.allclose(two[2], (y[on] * w[on, None]).T @ y[on])
    problems = [solve.Problem(DESIGN, 1.0), solve.Problem(DESIGN, 5.0, part=("f", 1, True)), solve.Problem(solve.Design(DESIGN.mains[:1]), 1.0)]
    for p, v in zip(problems, solve.newton_many(rows, problems, "y", solve.logistic), strict=True):
        z = dense(p.design, data, n)
        own = w * (data["f"] != 1) if p.part else w
        assert np.abs(z.T @ (own * (1 / (1 + np.exp(-z @ v)) - data["y"])) + p.l2 * v).max() < 1e-6
    v = solve.newton(rows, DESIGN, "m", solve.poisson, 2.0, False)
    g = x.T @ (w * (np.exp(x @ v) - data["m"])) + 2.0 * np.append(0, v[1:])
    assert np.abs(g).max() < 1e-6


def test_paths_start_warm_and_agree(table):
    df, data, n = table
    rows = solve.Rows(df, DESIGN.columns, ["y"], extra=["f"])
    designs = [solve.Design(DESIGN.mains), DESIGN]
    path = solve.logistic_path(rows, designs, "y", [1.0, 0.1], ("f", 0, True))
    for (i, c), v in path.items():
        alone = solve.logistic_l2(rows.part("f", 0, True), designs[i], "y", c)
        assert np.abs(alone - v).max() < 1e-8
    losses = solve.mean_losses(rows, [(designs[i], v) for (i, _), v in path.items()], "y", solve.logistic, [("f", 0, False)] * 4)
    z = dense(designs[1], data, n)[data["f"] == 0] @ path[1, 1.0]
    assert losses[list(path).index((1, 1.0))] == pytest.approx((np.log1p(np.exp(z)) - data["y"][data["f"] == 0] * z).mean())


def test_no_plan_has_a_dense_row(table):
    """Grouped rows hold states, not columns: what a pass reads is the design's columns and the target."""
    df, *_ = table
    rows = solve.Rows(df, DESIGN.columns, ["y"], driver_rows=0)
    assert rows.columns == ["a", "c", "b", "x", "y", "__w"] and rows.df.columns == rows.columns


def test_softmax_gradient(table):
    df, data, n = table
    design = solve.Design([("a", 4), ("b", 3)])
    v = solve.softmax_regression(solve.Rows(df, design.columns, ["f"]), design, "f", 3, 0.5)
    x, y = dense(design, data, n), np.eye(3)[data["f"].astype(int)]
    q = np.exp(x @ v)
    assert np.abs(x.T @ (q / q.sum(axis=1, keepdims=True) - y) + v / 0.5).max() < 1e-6


def test_nested_designs_fold_exactly(spark):
    """The folded tables give the score of the coarse and residual codes with their own coefficients."""
    from stateweave.models.base import Adapter

    features = [Feature(f"num:{c}", "numeric", c, 16, 0.0, [i / 16 for i in range(1, 16)]) for c in ("u", "v")]
    adapter = Adapter(features=features)
    for fine in (False, True):
        design = design_of(adapter, ["num:u", "num:v"], [("num:u", "num:v")], coding="nested", fine_pairs=fine)
        w = np.random.default_rng(1).normal(size=design.width)
        assert design.widths == [1, 15, 15, 255 if fine else 63]
        program = program_of(adapter, ["num:u", "num:v"], [("num:u", "num:v")], w, design, "identity")
        df = spark.range(3000).select((F.pmod(F.col("id") * 0.618034, F.lit(1.0))).alias("u"), (F.pmod(F.col("id") * 0.414214, F.lit(1.0))).alias("v"))
        states = df.select("u", "v", *[f.expression().alias(f.state_column) for f in features])
        codes = fn.nested_codes({"u": (features[0].state_column, 16), "v": (features[1].state_column, 16)}, [("u", "v")], fine_pairs=fine)
        parts, score = design.split(w), F.lit(float(w[0]))
        levels = [[("u", 4), ("u", 8), ("u", 16)], [("v", 4), ("v", 8), ("v", 16)], [("u_x_v", 4), ("u_x_v", 8), *([("u_x_v", 16)] if fine else [])]]
        sizes = {("u", 4): 3, ("u", 8): 4, ("u", 16): 8, ("v", 4): 3, ("v", 8): 4, ("v", 16): 8, ("u_x_v", 4): 15, ("u_x_v", 8): 48, ("u_x_v", 16): 192}
        for own, p in zip(levels, parts[1:], strict=True):
            at = 0
            for level in own:
                table = [0.0, *p[at : at + sizes[level]].tolist()]
                score, at = score + fn.lookup(codes[f"{level[0]}_{level[1]}"], table), at + sizes[level]
        wrong = states.select(F.abs(score - program.score({f.name: F.col(f.state_column) for f in features})).alias("d")).agg(F.max("d")).first()[0]
        assert wrong < 1e-12


def test_nested_classifier(spark, planted):
    model = StateClassifier(coding="nested", max_pairs=1, pair_features=3).fit(planted, ["u0", "u1", "u2"], "main", "key")
    assert model.score(planted, "main") > 0.8


def test_calibration_is_refused_and_accepted(spark):
    """Scores of an unpenalised fit are well calibrated; a heavy penalty shrinks them, which a scale mends."""
    rng = np.random.default_rng(5)
    s = rng.integers(0, 6, 12000)
    y = rng.random(12000) < 1 / (1 + np.exp(-np.array([-3.0, -2.0, -1.0, 1.0, 2.0, 3.0])[s]))
    rows = solve.Rows(spark.createDataFrame([(int(a), int(b), i % 3) for i, (a, b) in enumerate(zip(s, y, strict=True))], "s int, y int, f int"), ["s"], ["y"], extra=["f"])
    design = solve.Design([("s", 6)])
    good, bad = (solve.crossfitted_calibration(rows, design, "y", c, "f", 3) for c in (10.0, 0.001))
    assert not good.accepted and abs(good.scale - 1) < 0.05
    assert bad.accepted and bad.scale > 1.2 and bad.gain > 0.01 > bad.error


def test_rankings_in_turn_and_blocks_without_shrinkage():
    assert in_turn([1, 2, 3, 4, 5, 6, 7, 8], [9]) == [1, 9, 2, 3, 4, 5, 6, 7, 8] and in_turn([1, 2], [2, 3, 1]) == [1, 2, 3] and in_turn([], []) == []
    for h in (np.array([2.0, 0.0, 1.0]), np.zeros(3), np.array([0.0, 5.0, 0.0])):
        centres, scales = block_columns(h, 0.0)
        assert np.isfinite(centres).all() and np.isfinite(scales).all()
    assert block_columns(np.array([2.0, 0.0, 1.0]), 0.0)[1] == [1.0, 0.0]


def test_embedding_states_tell_nothing_of_noise(spark):
    """Labels are random; in-sample centroids would seem to tell them."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=32)], int(rng.integers(0, 2))) for i in range(600)]
    rows[3] = (3, None, 1)
    rows[4] = (4, [float("nan")] * 32, 0)
    rows[5] = (5, [1.0, 2.0], 1)
    df = spark.createDataFrame(rows, "key long, e array<double>, y int")
    for kind in ("basic", "prototype"):
        adapter = StateClassifier(embedding=kind)._adapter()
        states = adapter.fit(df, ["e"], "key", "y").toPandas()
        for f in adapter.features:
            if f.name.startswith(("embq", "embp", "embl")):
                share = states.groupby(f.state_column)["y"].mean()
                size = states.groupby(f.state_column).size()
                assert (np.abs(share - 0.5) < 4.5 * 0.5 / np.sqrt(size)).all(), f.name
        assert adapter.transform(df).count() == 600


def test_embedding_weights_and_moments(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 2, 300)
    w = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), float(w[i])) for i in range(300)], "key long, e array<double>, y int, w double")
    many = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(2)))).where("r <= w")
    a = adapt.Moments.of(df, "e", F.col("y"), F.col("key") % 4, 4, F.col("w"))
    b = adapt.Moments.of(many, "e", F.col("y"), F.col("key") % 4, 4)
    assert np.allclose(a.g, b.g)
    middle, d = a.centroid(without=2)
    keep = (np.arange(300) % 4 != 2) & (w > 0)
    c = [np.average(x[keep & (y == k)], axis=0, weights=w[keep & (y == k)]) for k in (0, 1)]
    scale = np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w))
    want = (((x - c[0]) / scale) ** 2).sum(axis=1) - (((x - c[1]) / scale) ** 2).sum(axis=1)
    assert np.allclose((x - middle) @ d, want)
    one, two = (adapt.prototypes(t, "e", "y", 4, weight=weight) for t, weight in ((df, F.col("w")), (many, None)))
    assert all(np.allclose(one[k], two[k]) for k in (0, 1))


def test_search_by_histograms(spark, planted):
    """Fewer fits, the same winner."""
    grid = {"max_pairs": [0, 1], "max_features": [1, 3]}
    x = ["u0", "u1", "u2"]
    base = StateClassifier(bins=4, c=1.0, pair_features=3)
    full = GridSearch(base, grid, folds=2).fit(planted, x, "gated", "key")
    quick = GridSearch(base, grid, folds=2, prefilter=True, keep=2).fit(planted, x, "gated", "key")
    assert quick.avoided_ == 2 and len(quick.results_) == 2 and quick.best_params_ == full.best_params_
    cache, n = quick.best_.newton_cache(planted, x, "gated", "key", prediction="model")
    left = cache.gains([1.0])[0][1.0]
    assert n == planted.count() and max(left.values()) < 5  # main effects have nothing left


def test_category_modes_and_pairs(spark):
    df = spark.range(400).select((F.col("id") % 16).cast("string").alias("a"), (F.col("id") % 17).cast("string").alias("b"), F.col("id").cast("string").alias("c"))
    assert adapt.category_mode(df, ["a", "b", "c"]) == {"a": "identity", "b": "ordered", "c": "ordered"}


def test_repeated_rows_are_kept_once(spark):
    """Rows that stay distributed but repeat are grouped once; later passes read the different ones."""
    df = spark.range(6000).selectExpr("CAST(id % 7 AS INT) AS a", "CAST(id % 11 < 4 AS INT) AS y", "CAST(id % 2 AS INT) AS f", "1.0 + id % 3 AS w").repartition(3)
    rows = solve.Rows(df, ["a"], ["y"], "w", driver_rows=10, extra=["f"])
    assert rows.local is None and rows.df.count() == 28
    design = solve.Design([("a", 7)])
    whole = solve.Rows(df, ["a"], ["y"], "w", extra=["f"])
    for got, want in ((rows, whole), (rows.part("f", 1), whole.part("f", 1))):
        for x, y in zip(solve.gram(got, design, ["y"]), solve.gram(want, design, ["y"]), strict=True):
            assert np.allclose(x, y, rtol=1e-12)
    assert solve.Rows(df.withColumn("z", F.monotonically_increasing_id()), ["a"], ["z"], driver_rows=10).df.count() == 6000


def test_threshold_head_passes_once_a_step(spark, monkeypatch):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, 3000)
    r = 0.5 * s + rng.normal(size=3000)
    cuts = [0.0, 0.5, 1.0]
    df = spark.createDataFrame([(int(a), *[int(b > t) for t in cuts]) for a, b in zip(s, r, strict=True)], "s int, b0 int, b1 int, b2 int")
    sizes = []
    monkeypatch.setattr(solve.Bank, "sum", lambda self, work, size, f=solve.Bank.sum: sizes.append(size) or f(self, work, size))
    solve.threshold_head(solve.Rows(df, ["s"], ["b0", "b1", "b2"]), solve.Design([("s", 4)]), ["b0", "b1", "b2"], solve.spline_basis(cuts))
    assert len(sizes) > 3 and len(set(sizes)) == 1  # all with derivatives: none for the value alone
