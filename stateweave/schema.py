"""Columns, their roles, and the checks of a fitted schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(ValueError):
    """Input that can't be used."""


class SchemaError(ValidationError):
    """A table that doesn't have the fitted columns."""


class ParameterError(ValidationError):
    """A parameter outside its range, or two that contradict each other."""


class AliasConflictError(ParameterError):
    """Two names of one parameter with different values."""


class ResourceLimitError(RuntimeError):
    """A fit that would exceed its budget."""


class ResourceWarning_(UserWarning):
    """A fit that may exceed its budget, with the policy "warn"."""


@dataclass(frozen=True)
class FeatureMeta:
    """An adapted column: logical name (``num:x``), physical name, kind and number of states (None: continuous)."""

    name: str
    column: str
    kind: str
    cardinality: int | None = None

    @property
    def nominal(self) -> bool:
        return self.kind in ("category", "category_bit", "missing")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def physical(logical: str) -> str:
    """A column name that needs no quoting."""
    return "".join(c if c.isalnum() else "_" for c in logical)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def infer_roles(df: DataFrame, features: list[str]) -> dict[str, list[str]]:
    """Numeric columns (numbers, Booleans, decimals), categories (strings), embeddings (arrays of numbers)."""
    roles: dict[str, list[str]] = {"numeric": [], "category": [], "embedding": []}
    for name in features:
        kind = df.schema[name].dataType
        if is_numeric(kind):
            roles["numeric"].append(name)
        elif isinstance(kind, T.StringType):
            roles["category"].append(name)
        elif isinstance(kind, T.ArrayType) and is_numeric(kind.elementType):
            roles["embedding"].append(name)
        else:
            raise ValidationError(f"column {name!r} has type {kind.simpleString()}; cast it to a number, a string or an array of numbers")
    return roles


def check_names(df: DataFrame) -> None:
    if len(set(df.columns)) != len(df.columns):
        raise SchemaError(f"duplicate column names: {sorted({c for c in df.columns if df.columns.count(c) > 1})}")


def aligned(df: DataFrame, fitted: list[str], keep: list[str] = ()) -> DataFrame:
    """The fitted columns in the fitted order, whatever the order of ``df``; missing or unexpected ones raise."""
    check_names(df)
    there = [c for c in df.columns if c not in set(keep)]
    missing, extra = [c for c in fitted if c not in there], [c for c in there if c not in fitted]
    if missing or extra:
        raise SchemaError(f"schema mismatch: missing={missing}, extra={extra}; pass the fitted columns, in any order")
    return df.select(*[quoted(c) for c in (*keep, *fitted)])


def finite(c):
    """Whether a double is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def numeric_table(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """All columns as doubles; raises if any value is missing or not finite (one aggregate)."""
    check_names(df)
    out = df.select(*[quoted(c) for c in keep], *[F.col(quoted(c)).cast("double").alias(c) for c in columns])
    bad = out.agg(*[F.count_if(~finite(F.col(quoted(c)))).alias(c) for c in columns]).first()
    wrong = {c: bad[c] for c in columns if bad[c]}
    if wrong:
        raise ValidationError(f"missing or non-finite values: {wrong}")
    return out
