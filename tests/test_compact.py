"""Tables of pairs that keep equal rows once, several outputs fitted one by one, weighted scores, exact quantiles."""

from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave.models import BlockClassifier, GeneralizedRegressor, MultiOutputRegressor, StateClassifier, StateRidgeRegressor
from stateweave.models.inspect import structure_table, summary
from stateweave.operators import solve
from stateweave.plans.program import Bundle, Feature, Program, SharedProgram
from stateweave.plans.rewrite import compacted, optimised
from stateweave.schema import ParameterError
from stateweave.sources.programs import load, save


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    u = [((i * p + 17 * k) % 10007) / 10007 for k, p in enumerate((3571, 7919, 1237))]
    df = spark.range(2000).select(i.alias("key"), *[x.alias(f"u{k}") for k, x in enumerate(u)])
    gate = F.when(F.col("u0") > 0.75, (F.col("u1") > 0.5).cast("double")).otherwise(0.5)
    df = df.withColumn("gated", (F.rand(3) < 0.05 + 0.9 * gate).cast("int")).withColumn("real", 3 * F.col("u0") + F.rand(4)).withColumn("other", 2 * F.col("u1") + F.rand(5))
    return spark.createDataFrame(df.collect(), df.schema).repartition(4).persist()


def wide_program() -> Program:
    features = {c: Feature(c, "numeric", c, n, 0.5, [k / n for k in range(1, n)]) for c, n in (("u0", 8), ("u1", 4), ("u2", 4))}
    rng = np.random.default_rng(0)
    block = np.zeros((8, 4))
    block[3] = rng.normal(size=4)  # one gate state of u0
    columns = np.tile(rng.normal(size=4)[:, None], (1, 4)) + np.array([0, 0, 0, 1.0]) * rng.normal(size=(4, 1))  # equal columns of u2
    return Program(features, 0.3, [("u0", rng.normal(size=8).tolist())], [("u0", "u1", block.tolist()), ("u1", "u2", columns.tolist()), ("u0", "u2", rng.normal(size=(8, 4)).tolist())])


def largest(df, a, b):
    return df.select(F.max(F.abs(a.score() - b.score()))).first()[0]


def test_equal_rows_are_stored_once(rows):
    dense = wide_program()
    small = compacted(dense)
    assert [(a, b, len(t)) for a, b, _, t in small.sparse] == [("u0", "u1", 2), ("u2", "u1", 2)] and len(small.pairs) == 1
    assert small.size_bytes() < dense.size_bytes()
    assert largest(rows, dense, small) < 1e-12
    assert sorted(small.used) == sorted(dense.used) and small.inputs == dense.inputs
    assert {(a, b) for a, b, _ in small.dense().pairs} == {("u0", "u2"), ("u0", "u1"), ("u2", "u1")}
    assert largest(rows, optimised(small), dense) < 1e-12 and largest(rows, compacted(optimised(small)), dense) < 1e-12
    assert largest(rows, small.calibrated(2.0, 1.0), dense.calibrated(2.0, 1.0)) < 1e-12
    assert Program.from_json(small.to_json()) == small and compacted(small).size_bytes() == small.size_bytes()
    for bits in (8, 16, 32):
        assert largest(rows, small.quantised(bits), dense) <= small.quantised(bits).error_bound() + 1e-12
    bundle = Bundle([small, dense], "labels", thresholds=[0.5, 0.5])
    p, q = SharedProgram.of(bundle).scores(), dense.score()
    assert rows.select(F.max(F.abs(p[0] - q) + F.abs(p[1] - q))).first()[0] < 1e-12


def test_compacting_leaves_what_gains_nothing(rows):
    features = {c: Feature(c, "numeric", c, 2, 0.5, [0.5]) for c in ("u0", "u1")}
    program = Program(features, 0.0, [], [("u0", "u1", [[1.0, 2.0], [3.0, 4.0]])])
    assert compacted(program) == program and compacted(Program({}, 1.0)) == Program({}, 1.0)
    same = compacted(replace(program, pairs=[("u0", "u1", [[1.0, 2.0], [1.0, 2.0]])]))
    assert same.sparse == [("u0", "u1", [0, 0], [[1.0, 2.0]])]


def test_blocks_are_stored_by_rows(spark, rows, tmp_path):
    model = BlockClassifier(bins=4, max_pairs=0, pair_features=3, max_blocks=1, c=0.5).fit(rows, ["u0", "u1", "u2"], "gated", "key")
    assert model.diagnostics_[0]["blocks"] and model.program_.sparse
    assert model.program_.size_bytes() < model.program_.dense().size_bytes() and largest(rows, model.program_, model.program_.dense()) < 1e-12
    save(model, str(tmp_path / "m"))
    assert load(str(tmp_path / "m")).program_ == model.program_
    assert structure_table(spark, model).first()["pairs"] == summary(model)["pairs"] >= len(model.program_.sparse)


def test_outputs_one_by_one(spark, rows):
    options = {"bins": 4, "pair_features": 2, "max_pairs": 1}
    each = MultiOutputRegressor(mode="independent", **options).fit(rows, ["u0", "u1", "u2"], ["real", "other"], "key")
    for t in ("real", "other"):
        alone = StateRidgeRegressor(alpha=1.0, max_features=16, **options).fit(rows, ["u0", "u1", "u2"], t, "key")
        assert each.programs_[t] == alone.program_
    assert [r["head"] for r in structure_table(spark, each).collect()] == ["real", "other"]
    # four targets in equal parts of all combinations of signs: no direction stands out, so each is fitted alone
    i = F.col("key")
    flat = rows.where("key < 1984").select("key", "u0", "u1", *[(2.0 * (F.floor(i / 2**k) % 2) - 1).alias(f"t{k}") for k in range(4)])
    names = [f"t{k}" for k in range(4)]
    fallen, own = (MultiOutputRegressor(mode=m, **options).fit(flat, ["u0", "u1"], names, "key") for m in ("subspace", "independent"))
    assert fallen.rank_ == 0 and fallen.strategy_ == "independent" and fallen.programs_ == own.programs_
    assert MultiOutputRegressor(mode="shared", **options).fit(rows, ["u0"], ["real", "other"], "key").strategy_ == "shared"
    with pytest.raises(ParameterError):
        MultiOutputRegressor(mode="other").fit(rows, ["u0"], ["real"], "key")


def test_scores_of_weighted_rows(rows):
    weighted = rows.withColumn("w", (F.col("key") % 3).cast("double"))
    repeated = weighted.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(2)))).where("again <= w").drop("again")
    a = StateRidgeRegressor(bins=4, max_pairs=0).fit(rows, ["u0", "u1"], "real", "key")
    b = StateClassifier(bins=4, max_pairs=0).fit(rows, ["u0", "u1"], "gated", "key")
    for model, target in ((a, "real"), (b, "gated")):
        assert model.score(weighted, target, "w") == pytest.approx(model.score(repeated, target), abs=1e-12)
        assert model.score(weighted, target) == pytest.approx(model.score(rows, target))


def local_rows(spark, columns: dict, design, weight=None):
    """Solver rows of plain lists."""
    names = list(columns)
    kinds = {c: float if c in ("y", "w", "o") else int for c in names}
    df = spark.createDataFrame([tuple(kinds[c](v) for c, v in zip(names, row, strict=True)) for row in zip(*columns.values(), strict=True)], names)
    return solve.Rows(df, design.columns, ["y"], weight, extra=["o"] if "o" in columns else [])


def best_by_corners(x: np.ndarray, y: np.ndarray, q: float, l1: float) -> float:
    """The least mean pinball loss and penalty over all corners of the linear programme."""
    n, p = x.shape
    planes = np.vstack([x, np.eye(p)[1:]])
    right = np.concatenate([y, np.zeros(p - 1)])
    least = np.inf
    for at in combinations(range(len(planes)), p):
        m = planes[list(at)]
        if abs(np.linalg.det(m)) > 1e-9:
            w = np.linalg.solve(m, right[list(at)])
            r = y - x @ w
            least = min(least, np.maximum(q * r, (q - 1) * r).mean() + l1 * np.abs(w[1:]).sum())
    return least


@pytest.mark.parametrize("q,l1", [(0.5, 0.0), (0.2, 0.0), (0.8, 0.02), (0.5, 0.05), (0.3, 10.0)])
def test_quantile_programme_against_all_corners(spark, q, l1):
    rng = np.random.default_rng(int(100 * q))
    a, b = np.repeat([0, 1, 2], 6), np.tile([0, 1], 9)
    y = np.round(a + 2.0 * b + rng.normal(size=18), 1)  # ties
    design = solve.Design([("a", 3), ("b", 2)])
    w, gap = solve.quantile_regression(local_rows(spark, {"a": a, "b": b, "y": y}, design), design, "y", q, l1, spread=float(y.std()))
    x = np.column_stack([np.ones(18), a == 1, a == 2, b == 1]).astype(float)
    r = y - x @ w
    loss = np.maximum(q * r, (q - 1) * r).mean() + l1 * np.abs(w[1:]).sum()
    assert loss - best_by_corners(x, y, q, l1) < 1e-6 and gap < 1e-6
    assert l1 < 1 or np.abs(w[1:]).max() < 1e-4


def test_exact_quantiles_of_an_estimator(rows):
    model = GeneralizedRegressor(loss="quantile", quantiles=(0.1, 0.9), penalty="l1", alpha=0.0, bins=4, max_pairs=0).fit(rows, ["u0"], "real", "key")
    got = model.predict(rows).select((F.floor(F.col("u0") * 4)).alias("s"), "real", *[F.col("prediction")[k].alias(f"p{k}") for k in (0, 1)]).toPandas()
    for k, q in ((0, 0.1), (1, 0.9)):
        loss = lambda v, at: np.maximum(q * (v - at), (q - 1) * (v - at)).sum()  # noqa: B023, E731
        least = sum(min(loss(g.real.values, at) for at in np.sort(g.real.values)[[int(q * len(g)) + d for d in (-1, 0, 1) if 0 <= int(q * len(g)) + d < len(g)]]) for _, g in got.groupby(f"p{k}"))
        assert sum(loss(g.real.values, g[f"p{k}"].values) for _, g in got.groupby(f"p{k}")) - least < 1e-5 * len(got)
    assert max(model.gaps_) < 1e-6 * 3
    none = GeneralizedRegressor(loss="quantile", penalty="l1", alpha=100.0, bins=4, max_pairs=0).fit(rows, ["u0"], "real", "key")
    assert none.predict(rows).agg(F.max("prediction") - F.min("prediction")).first()[0] < 1e-3
    with pytest.raises(ParameterError):
        GeneralizedRegressor(loss="poisson", penalty="l1").fit(rows, ["u0"], "real", "key")
