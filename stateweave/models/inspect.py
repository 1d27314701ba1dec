"""Fitted models as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.program import Program


def heads_of(model) -> list[tuple[str, Program]]:
    if getattr(model, "bundle_", None) is not None:
        return [(str(c), h) for c, h in zip(model.bundle_.classes, model.bundle_.heads, strict=True)]
    if isinstance(getattr(model, "programs_", None), dict):
        return list(model.programs_.items())
    if getattr(model, "programs_", None):
        return [(str(i), p) for i, p in (model.programs_.items() if isinstance(model.programs_, dict) else enumerate(model.programs_))]
    return [("", model.__dict__.get("program_") or model.__dict__["baseline_"])]


def feature_table(spark: SparkSession, model) -> DataFrame:
    """head, feature, kind, states, low and high entry of the feature's table."""
    rows = [(h, f, p.features[f].kind, p.features[f].cardinality, min(t), max(t)) for h, p in heads_of(model) for f, t in p.unary]
    return spark.createDataFrame(rows, "head string, feature string, kind string, states int, low double, high double")


def interaction_table(spark: SparkSession, model) -> DataFrame:
    """head, left, right, cells, low and high entry of the pair's table."""
    rows = [(h, a, b, len(t) * len(t[0]), min(map(min, t)), max(map(max, t))) for h, p in heads_of(model) for a, b, t in p.dense().pairs]
    return spark.createDataFrame(rows, "head string, left string, right string, cells int, low double, high double")


def structure_table(spark: SparkSession, model) -> DataFrame:
    """head, intercept, number of single tables, pairs, linear terms, bytes."""
    rows = [(h, p.intercept, len(p.unary), len(p.pairs) + len(p.sparse), len(p.linear), p.size_bytes()) for h, p in heads_of(model)]
    return spark.createDataFrame(rows, "head string, intercept double, mains int, pairs int, linear int, bytes int")


def summary(model) -> dict:
    """The model in one dictionary: parameters, inputs in use, sizes, what the fit chose."""
    heads = heads_of(model)
    return {
        "estimator": type(model).__name__, "params": model.get_params(), "columns": model.columns_,
        "inputs": sorted({c for _, p in heads for c in p.inputs}), "heads": len(heads), "bytes": sum(p.size_bytes() for _, p in heads),
        "mains": sum(len(p.unary) for _, p in heads), "pairs": sum(len(p.pairs) + len(p.sparse) for _, p in heads), "diagnostics": model.diagnostics_ if hasattr(model, "__dict__") and "diagnostics_" in model.__dict__ else {},
    }


def versions() -> dict[str, str]:
    """Versions of what runs here."""
    import platform

    import numpy
    import pyarrow
    import pyspark

    from .. import __version__

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "stateweave": __version__}
