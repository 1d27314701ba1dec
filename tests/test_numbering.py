"""Row numbers by ranges equal those of one window."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stateweave import keys
from stateweave.operators import adapt
from stateweave.operators.numbering import numbered


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("share", [3, 10**9])
def test_equal_to_a_window(spark, share):
    """A hot group, a null group, ties and names that clash with the operator's own."""
    df = spark.range(0, 4000, 1, 7).select(
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % share == 0, F.lit(5)).otherwise(F.col("id") % 700).alias("g"),
        F.when(F.col("id") % 13 == 0, None).otherwise((F.col("id") * 7919) % 997).alias("__n0"), F.col("id").alias("r.id"),
    )
    order = [F.col("__n0").asc_nulls_first(), F.col("`r.id`")]
    want = df.withColumn("k", (F.row_number().over(Window.partitionBy("g").orderBy(*order)) + 4).cast("bigint"))
    assert rows_of(numbered(df, order, "k", ["g"], first=5)) == rows_of(want)


def test_whole_table_empty_table_and_repeats(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("x"))
    assert sorted((r.x, r.k) for r in numbered(df, [F.col("x")], "k").collect()) == [(x, k) for k, x in enumerate(sorted(i % 3 for i in range(500)))]
    assert numbered(df.where("x > 5"), [F.col("x")], "k", ["x"]).count() == 0


def test_folds_and_subsamples(spark):
    """As numbered by one window over each target value; no window in the plan has the target value alone."""
    df = spark.range(3000).select((F.col("id") * 31 % 3001).alias("key"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2).alias("y"))
    whole = Window.partitionBy("y")
    k = F.row_number().over(whole.orderBy(keys.scramble(F.col("key"), 3), F.col("key")))
    folds = keys.stratified_folds(df, "key", "y", 5, 3)
    assert rows_of(folds) == rows_of(df.withColumn("fold", F.pmod(k - 1, F.lit(5)).cast("int")))
    want = df.withColumn("k", k).withColumn("n", F.count("*").over(whole)).where("k <= greatest(8, ceil(n * 0.1))").select("key", "y")
    assert rows_of(keys.stratified_subsample(df, "key", "y", 0.1, seed=3)) == rows_of(want)


def test_dictionary_of_many_values(spark, monkeypatch):
    df = spark.range(300).select(F.concat(F.lit("v"), F.col("id") * 7 % 301).alias("c"))
    want = rows_of(adapt.dictionary(df, "c"))
    monkeypatch.setattr(adapt, "BROADCAST_CATEGORIES", 10)
    assert rows_of(adapt.dictionary(df, "c")) == want
