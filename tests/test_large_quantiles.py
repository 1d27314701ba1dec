"""Exact quantiles the way large tables take them: by histograms over shrinking ranges."""

import numpy as np
import pytest
from test_queries import duck, test_matches_sql as matches_sql  # noqa: F401  a fixture, and the comparison with DuckDB

from stateweave.operators import quantiles


@pytest.mark.parametrize("name", ["quantile_thresholds_4_8_16", "weighted_quantile_freq", "weighted_thresholds", "nested_codes", "mi_feature_rank", "resolution_gain", "pair_rank_mi"])
def test_queries_by_histograms(spark, duck, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(quantiles, "BUFFER_VALUES", 0)
    matches_sql(spark, duck, name)


def test_values_of_all_sizes(spark, monkeypatch):
    """Outliers, neighbouring doubles, signed zeros, gaps and ties."""
    monkeypatch.setattr(quantiles, "BUFFER_VALUES", 0)
    x = np.random.default_rng(1).normal(size=400)
    a = [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0, float("nan"), None, *np.exp(40 * x).tolist()]
    b = [1.0, float(np.nextafter(1, 2)), float("inf"), None, *[1.0] * 50, *[2.0] * 354]
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a double, b double")
    p = [i / 16 for i in range(17)]
    got = quantiles.exact_quantiles(df, ["a", "b"], p)
    for c, values in (("a", a), ("b", b)):
        known = np.sort([v for v in values if v is not None and np.isfinite(v)])
        at = np.array(p) * (len(known) - 1)
        low, high = known[np.floor(at).astype(int)], known[np.ceil(at).astype(int)]
        assert got[c] == (low + (at - np.floor(at)) * (high - low)).tolist()
        assert {type(v) for v in got[c]} == {float}


def test_orders_are_joined_once(spark):
    """Every pass of a query over the order features reads a table, not the join of two."""
    from stateweave.queries import kept_features, order_states

    for df in (order_states(spark, "/root/testdata/sf0.001"), kept_features(spark, "/root/testdata/sf0.001")):
        assert "Join" not in df._jdf.queryExecution().toString()


def test_passes_do_not_grow_with_probabilities(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(quantiles, "BUFFER_VALUES", 0)
    monkeypatch.setattr(quantiles, "_histograms", lambda *a, f=quantiles._histograms: passes.append(len(a[2])) or f(*a))
    df = spark.range(20000).selectExpr("id / 100 AS a", "if(id = 7, 1e9, pow(id, 1.5)) AS b")
    cuts = quantiles.nested_thresholds(df, ["a", "b"], (4, 64))
    assert cuts["a"][4] == pytest.approx([49.9975, 99.995, 149.9925]) and len(cuts["b"][64]) == 63
    assert len(passes) <= 4 and max(passes) <= 130


def test_few_values_in_one_pass(spark):
    df = spark.createDataFrame([(float(i % 5), float(i), None) for i in range(50)] + [(float("nan"), -0.0, None)], "a double, b double, c double").repartition(3)
    assert quantiles.few_values(df, ["a", "b", "c"], 5) == {"a": [0.0, 1.0, 2.0, 3.0, 4.0], "c": []}
    assert quantiles.few_values(df, ["a"], 4) == {}
