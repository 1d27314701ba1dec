"""The catalogue of queries, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import functions as fn
from .keys import scramble, stratified_folds, stratified_subsample
from .models import FusedRegressor, GeneralizedRegressor, MultiLabelClassifier, MultiOutputRegressor, SharedClassifier, StateClassifier, StateRidgeRegressor
from .operators import adapt, quantiles, rank, solve, stats
from .plans.program import Bundle, Feature, Program, constant_program
from .plans.rewrite import optimised
from .sources import order_features, table
from .sources.interim import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUMERIC = ["price", "balance", "day", "month"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# pieces of SQL ----------------------------------------------------------------------------------------------------

OC = """oc AS (SELECT o_orderkey, o_totalprice AS price, c_acctbal AS balance, CAST(day(o_orderdate) AS DOUBLE) AS day,
  CAST(month(o_orderdate) AS DOUBLE) AS month, o_orderpriority AS priority, c_mktsegment AS segment,
  o_orderstatus AS status, CAST(o_orderstatus = 'F' AS INTEGER) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def cuts_sql(column: str, source: str, bins: int) -> str:
    """The thresholds of a column: rounded quantiles strictly inside its range."""
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    return (
        f"(SELECT list_sort(list_distinct(list_transform(list_filter(quantile_cont(CAST({column} AS DOUBLE), [{probs}]), "
        f"lambda t: t > min({column}) AND t < max({column})), lambda t: round(t, 9)))) FROM {source})"
    )


def midpoints_sql(column: str, source: str) -> str:
    return f"(SELECT list(m ORDER BY m) FILTER (WHERE m IS NOT NULL) FROM (SELECT round((v + lead(v) OVER (ORDER BY v)) / 2, 9) AS m FROM (SELECT DISTINCT CAST({column} AS DOUBLE) AS v FROM {source})))"


def state_sql(column: str, cuts: str) -> str:
    return f"CAST(len(list_filter({cuts}, lambda t: t <= {column})) AS INTEGER)"


def order_states_sql(bins: int) -> str:
    """oc and st: the states of the four numeric columns of orders at a level (month has 12 values)."""
    cut = {c: midpoints_sql(c, "oc") if c == "month" and bins >= 12 else cuts_sql(c, "oc", bins) for c in NUMERIC}
    th = ", ".join(f"{cut[c]} AS t_{c}" for c in NUMERIC)
    return f"{OC}, th AS (SELECT {th}), st AS (SELECT oc.*, {', '.join(f'{state_sql(c, f't_{c}')} AS s_{c}' for c in NUMERIC)} FROM oc, th)"


def kept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order features, joined once and kept as a table: for what passes over them many times."""
    return stored(order_features(spark, sf_dir))


def order_states(spark: SparkSession, sf_dir: str, bins: int = 4) -> DataFrame:
    """The order features with states s_price, s_balance, s_day, s_month."""
    df = kept_features(spark, sf_dir)
    cuts = quantiles.nested_thresholds(df, NUMERIC, (bins,), digits=9)
    return df.select("*", *[fn.state(F.col(c), cuts[c][bins]).alias(f"s_{c}") for c in NUMERIC])


STATES = [f"s_{c}" for c in NUMERIC]
PAIRS = stats.pairs_of(STATES)
LONG = " UNION ALL ".join(f"SELECT '{s}' AS feature, {s} AS state, y, status, price, o_orderkey FROM st" for s in STATES)
LONG_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS f0, '{b}' AS f1, {a} AS s0, {b} AS s1, y, status, price, o_orderkey FROM st" for a, b in PAIRS)
LONG_DIRECTED = " UNION ALL ".join(f"SELECT '{a}' AS f0, '{b}' AS f1, {a} AS s0, {b} AS s1, y, o_orderkey FROM st" for a in STATES for b in STATES if a != b)


def mi_sql(source: str, by: str, state: str, target: str) -> str:
    """by, mi from rows."""
    return (
        f"SELECT {by}, sum(n / tot * ln(n * tot / (ns * ny))) AS mi FROM (SELECT {by}, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY {by}) AS DOUBLE) AS tot, "
        f"CAST(sum(n) OVER (PARTITION BY {by}, {state}) AS DOUBLE) AS ns, CAST(sum(n) OVER (PARTITION BY {by}, {target}) AS DOUBLE) AS ny FROM (SELECT {by}, {state}, {target}, count(*) AS n FROM ({source}) GROUP BY ALL)) GROUP BY {by}"
    )


# scans and scalar transforms --------------------------------------------------------------------------------------

_LINE_CUTS = ", ".join(f"{cuts_sql(c, 'lineitem', 8)} AS t_{c}" for c in LINE)
_LINE_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS idx, {state_sql(c, f't_{c}')} AS state, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem, th" for i, c in enumerate(LINE))


@query(f"WITH th AS (SELECT {_LINE_CUTS}), x AS ({_LINE_LONG}), m AS ({mi_sql('SELECT * FROM x', 'feature', 'state', 'y')}) SELECT feature, round(mi, 9) AS mi, CAST(row_number() OVER (ORDER BY round(mi, 9) DESC, list_position({LINE}, feature)) AS INTEGER) AS rank FROM m")
def mi_feature_rank(spark, sf_dir):
    """Numeric line-item columns by their information about returns, at 8 levels."""
    df = table(spark, sf_dir, "lineitem").select(*LINE, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    cuts = quantiles.nested_thresholds(df, LINE, (8,), digits=9)
    states = df.select("y", *[fn.state(F.col(c), cuts[c][8]).alias(c) for c in LINE])
    scores = stats.mutual_information(stats.state_cells(states, LINE, ["y"]), ["feature"], ["state"], "y")
    return rank.top_features(scores, LINE, "mi", 4).select("feature", "mi", "rank")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {b} AS level, CAST(i AS INTEGER) AS idx, round(t[i], 6) AS threshold FROM (SELECT {cuts_sql(c, s, b)} AS t), (SELECT unnest(range(1, {b})) AS i) WHERE i <= len(t)" for c, s in (("l_extendedprice", "lineitem"), ("c_acctbal", "customer")) for b in (4, 8, 16)))
def quantile_thresholds_4_8_16(spark, sf_dir):
    """Nested thresholds of two columns."""
    rows = []
    for c, t in (("l_extendedprice", "lineitem"), ("c_acctbal", "customer")):
        cuts = quantiles.nested_thresholds(table(spark, sf_dir, t), [c], digits=9)[c]
        rows += [(c, b, i + 1, round(x, 6)) for b in (4, 8, 16) for i, x in enumerate(cuts[b])]
    return spark.createDataFrame(rows, "feature string, level int, idx int, threshold double")


@query(f"WITH th AS (SELECT {cuts_sql('c_acctbal', 'customer', 16)} AS t), s AS (SELECT {state_sql('c_acctbal', 't')} AS s16 FROM customer, th) SELECT s16, CAST(least(floor(s16 * 8 / 16), 7) AS INTEGER) AS s8, CAST(least(floor(s16 * 4 / 16), 3) AS INTEGER) AS s4, count(*) AS n FROM s GROUP BY 1, 2, 3")
def nested_state_counts(spark, sf_dir):
    """Customers by balance at 16, 8 and 4 nested levels."""
    df = table(spark, sf_dir, "customer")
    fine = fn.state(F.col("c_acctbal"), quantiles.nested_thresholds(df, ["c_acctbal"], (16,), digits=9)["c_acctbal"][16])
    return df.select(fine.alias("s16")).withColumn("s8", fn.coarser(F.col("s16"), 16, 8)).withColumn("s4", fn.coarser(F.col("s16"), 16, 4)).groupBy("s16", "s8", "s4").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS v FROM orders), m AS (SELECT quantile_cont(v, 0.5) AS med FROM x WHERE v IS NOT NULL AND NOT isnan(v)) SELECT o_orderkey, round(CASE WHEN v IS NULL OR isnan(v) THEN med ELSE v END, 6) AS value, CAST(v IS NULL OR isnan(v) AS INTEGER) AS missing FROM x, m")
def impute_missing_flags(spark, sf_dir):
    """Median imputation with a missing flag, on prices with gaps put in by key."""
    v = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    value, missing = adapt.imputed("v", adapt.medians(df, ["v"])["v"])
    return df.select("o_orderkey", F.round(value, 6).alias("value"), missing.alias("missing"))


_PRIO = "p AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS s FROM (SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderkey % 5 <> 0))"


@query(f"WITH {_PRIO} SELECT o_orderkey, coalesce(s, (SELECT CAST(count(*) AS INTEGER) FROM p)) AS state FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'unseen' ELSE o_orderpriority END AS c FROM orders) LEFT JOIN p ON c = value")
def identity_category_states(spark, sf_dir):
    """Priorities to states; nulls and unseen values share a last state."""
    orders = table(spark, sf_dir, "orders")
    fitted = adapt.dictionary(orders.where("o_orderkey % 5 <> 0"), "o_orderpriority")
    c = F.when(F.col("o_orderkey") % 9 == 0, None).when(F.col("o_orderkey") % 13 == 0, F.lit("unseen")).otherwise(F.col("o_orderpriority"))
    return adapt.with_dictionary(orders.select("o_orderkey", c.alias("c")), "c", fitted, "state", F.lit(fitted.count()), "state").select("o_orderkey", "state")


@query("WITH p AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS s FROM (SELECT DISTINCT p_brand AS value FROM part)) SELECT p_partkey, s AS state, s & 1 AS b0, (s >> 1) & 1 AS b1, (s >> 2) & 1 AS b2 FROM part JOIN p ON p_brand = value")
def category_bits(spark, sf_dir):
    """Brands as states and their lowest three binary digits."""
    df = adapt.category_states(table(spark, sf_dir, "part"), "p_brand", "state")
    return df.select("p_partkey", "state", *[b.alias(f"b{i}") for i, b in enumerate(adapt.category_bits(F.col("state"), 8))])


_FOLDS = "f AS (SELECT oc.*, CAST((row_number() OVER (PARTITION BY y ORDER BY (o_orderkey * 7919 + 3) % 1000003, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM oc)"


@query(f"WITH {OC}, {_FOLDS} SELECT y, fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM f GROUP BY 1, 2")
def stratified_fold_sizes(spark, sf_dir):
    """Stratified folds by key."""
    return stratified_folds(order_features(spark, sf_dir), "o_orderkey", "y", 5, 3).groupBy("y", "fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"WITH {OC}, {_FOLDS}, g AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE priority END AS c, * FROM f), k AS (SELECT c, fold, sum(y) AS s, count(*) AS n FROM g GROUP BY 1, 2), kk AS (SELECT *, sum(s) OVER (PARTITION BY c) - s AS rs, sum(n) OVER (PARTITION BY c) - n AS rn, (sum(s) OVER () - sum(s) OVER (PARTITION BY fold)) / (sum(n) OVER () - sum(n) OVER (PARTITION BY fold)) AS m FROM k) SELECT o_orderkey, round(CASE WHEN g.c IS NULL THEN m ELSE (rs + 20 * m) / (rn + 20) END, 9) AS score FROM g JOIN kk ON g.c IS NOT DISTINCT FROM kk.c AND g.fold = kk.fold")
def oof_target_quotient(spark, sf_dir):
    """Out-of-fold smoothed target means of priorities (with nulls put in by key)."""
    df = stratified_folds(order_features(spark, sf_dir), "o_orderkey", "y", 5, 3).withColumn("c", F.when(F.col("o_orderkey") % 17 == 0, None).otherwise(F.col("priority")))
    return adapt.out_of_fold_scores(df, "c", F.col("y"), "fold").select("o_orderkey", F.round("score", 9).alias("score"))


@query(f"WITH {OC}, m AS (SELECT avg(y) AS p FROM oc) SELECT segment AS value, round(sum(y - p) / (sum(p * (1 - p)) + 10), 9) AS score FROM oc, m GROUP BY 1")
def newton_quotient(spark, sf_dir):
    """Newton scores of segments at the constant model."""
    df = order_features(spark, sf_dir)
    p = df.agg(F.avg("y")).first()[0]
    return rounded(adapt.newton_scores(df, "segment", F.col("y") - p, F.lit(p * (1 - p))), 9)


@query(f"WITH {OC}, f AS (SELECT *, CAST((o_orderkey * 7919) % 1000003 % 4 AS INTEGER) AS fold, coalesce(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE segment END, '<missing>') AS c FROM oc), k AS (SELECT c, fold, sum(price) AS s, count(*) AS n FROM f GROUP BY 1, 2), kk AS (SELECT *, sum(s) OVER (PARTITION BY c) - s AS rs, sum(n) OVER (PARTITION BY c) - n AS rn, (sum(s) OVER () - sum(s) OVER (PARTITION BY fold)) / (sum(n) OVER () - sum(n) OVER (PARTITION BY fold)) AS m FROM k) SELECT c AS category, fold, round((rs + 20 * m) / (rn + 20), 5) AS score FROM kk")
def regression_quotient(spark, sf_dir):
    """Out-of-fold mean prices of segments; missing is a category of its own."""
    df = order_features(spark, sf_dir).withColumn("fold", F.pmod(scramble(F.col("o_orderkey")), F.lit(4)).cast("int")).withColumn("c", F.when(F.col("o_orderkey") % 17 == 0, None).otherwise(F.col("segment")))
    scored = adapt.out_of_fold_scores(df, "c", F.col("price"), "fold", missing_as_key=True)
    return scored.groupBy(F.coalesce("c", F.lit(adapt.MISSING_KEY)).alias("category"), "fold").agg(F.round(F.min("score"), 5).alias("score"))


@query("WITH r AS (SELECT l_extendedprice AS v FROM lineitem, unnest(range(CAST(l_quantity AS BIGINT))) WHERE l_quantity > 0), q AS (SELECT quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM r) SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS p, round(unnest(q), 6) AS q FROM q")
def weighted_quantile_freq(spark, sf_dir):
    """Quantiles of price, each line counted as often as its quantity."""
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    q = quantiles.weighted_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", probs)
    return spark.createDataFrame([(p, round(v, 6)) for p, v in zip(probs, q, strict=True)], "p double, q double")


@query("WITH s AS (SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) AS INTEGER) AS r, p_size / 2.0 AS x FROM part) SELECT p_partkey, CAST(CASE WHEN abs(r - x) < 1e-9 AND r >= 0 AND r < 20 THEN r ELSE 0 END AS INTEGER) AS state FROM s")
def direct_states(spark, sf_dir):
    """Half sizes that are states already; anything else is state 0."""
    return table(spark, sf_dir, "part").select("p_partkey", fn.direct_state(F.col("p_size") / 2.0, 20, 0).alias("state"))


# cell statistics --------------------------------------------------------------------------------------------------


@query(f"WITH {order_states_sql(4)}, x AS ({LONG}) SELECT feature, state, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(sum(price), 2) AS price FROM x GROUP BY 1, 2")
def state_histogram(spark, sf_dir):
    """Mass and two sums for each state of each feature."""
    return stats.state_cells(order_states(spark, sf_dir), STATES, sums={"positives": F.col("y"), "price": F.col("price")}).withColumn("price", F.round("price", 2))


@query(f"WITH {order_states_sql(4)}, x AS ({LONG_PAIRS}) SELECT f0, f1, CAST(s0 * 4 + s1 AS INTEGER) AS code, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM x GROUP BY 1, 2, 3")
def pair_histogram(spark, sf_dir):
    """Mass and positives for each joint state of each pair."""
    cells = stats.tuple_cells(order_states(spark, sf_dir), PAIRS, sums={"positives": F.col("y")})
    return cells.select("f0", "f1", fn.pair_code(F.col("s0"), F.col("s1"), 4).cast("int").alias("code"), "n", "positives")


_TRIPLES = [(a, b, c) for i, a in enumerate(STATES) for j, b in enumerate(STATES[i + 1 :], i + 1) for c in STATES[j + 1 :]]


@query("WITH " + order_states_sql(4) + ", m AS (SELECT avg(y) AS p FROM st), x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS f0, '{b}' AS f1, '{c}' AS f2, {a} AS s0, {b} AS s1, {c} AS s2, y FROM st" for a, b, c in _TRIPLES) + ") SELECT f0, f1, f2, s0, s1, s2, count(*) AS n, round(sum(y - p), 6) AS g, round(sum(p * (1 - p)), 6) AS h FROM x, m GROUP BY ALL")
def triad_histogram(spark, sf_dir):
    """Gradient and Hessian for each joint state of each triple."""
    df = order_states(spark, sf_dir)
    p = df.agg(F.avg("y")).first()[0]
    return rounded(stats.tuple_cells(df, _TRIPLES, sums={"g": F.col("y") - p, "h": F.lit(p * (1 - p))}))


_MI1 = mi_sql("SELECT * FROM x", "feature", "state", "y")
_MI2 = mi_sql("SELECT * FROM xp", "f0, f1", "s0, s1", "y")
_POS = f"{STATES}"


@query(f"WITH {order_states_sql(8)}, x AS ({LONG}), xp AS ({LONG_PAIRS}), m1 AS ({_MI1}), m2 AS ({_MI2}), e AS (SELECT m2.f0, m2.f1, round(m2.mi - greatest(a.mi, b.mi), 9) AS excess, round(m2.mi, 9) AS mi FROM m2 JOIN m1 a ON a.feature = f0 JOIN m1 b ON b.feature = f1) SELECT *, CAST(row_number() OVER (ORDER BY excess DESC, mi DESC, list_position({_POS}, f0) DESC, list_position({_POS}, f1) DESC) AS INTEGER) AS rank FROM e QUALIFY rank <= 4")
def pair_rank_mi(spark, sf_dir):
    """Pairs by what they tell beyond the better of their two features."""
    df = order_states(spark, sf_dir, 8)
    single = stats.mutual_information(stats.state_cells(df, STATES, ["y"]), ["feature"], ["state"], "y")
    pair = stats.mutual_information(stats.tuple_cells(df, PAIRS, ["y"]), ["f0", "f1"], ["s0", "s1"], "y")
    return rank.top_pairs(rank.with_marginals(pair, single, "mi"), STATES, "excess", 4, "mi").select("f0", "f1", "excess", "mi", "rank")


_GH = "gh AS (SELECT st.*, y - p AS g, p * (1 - p) AS h FROM st, (SELECT avg(y) AS p FROM st))"
_LONG_GH = " UNION ALL ".join(f"SELECT '{s}' AS feature, {s} AS state, g, h FROM gh" for s in STATES)
_PAIRS_GH = " UNION ALL ".join(f"SELECT '{a}' AS f0, '{b}' AS f1, {a} AS s0, {b} AS s1, g, h FROM gh" for a, b in PAIRS)


def _newton_sql(l2: str) -> str:
    return (
        f"n1 AS (SELECT feature, {l2} AS l2, sum(g * g / (h + {l2})) / 2 AS gain FROM c1 GROUP BY ALL), n2 AS (SELECT f0, f1, {l2} AS l2, sum(g * g / (h + {l2})) / 2 AS gain FROM c2 GROUP BY ALL), "
        f"e AS (SELECT n2.l2, n2.f0, n2.f1, round(n2.gain - greatest(a.gain, b.gain), 9) AS excess, round(n2.gain, 9) AS gain FROM n2 JOIN n1 a ON a.feature = f0 AND a.l2 = n2.l2 JOIN n1 b ON b.feature = f1 AND b.l2 = n2.l2)"
    )


_CELLS = f"c1 AS (SELECT feature, state, sum(g) AS g, sum(h) AS h FROM ({_LONG_GH}) GROUP BY 1, 2), c2 AS (SELECT f0, f1, s0, s1, sum(g) AS g, sum(h) AS h FROM ({_PAIRS_GH}) GROUP BY 1, 2, 3, 4)"


def _gradient_cells(spark, sf_dir, bins=8):
    df = order_states(spark, sf_dir, bins)
    p = df.agg(F.avg("y")).first()[0]
    sums = {"g": F.col("y") - p, "h": F.lit(p * (1 - p))}
    return df, stats.state_cells(df, STATES, sums=sums), stats.tuple_cells(df, PAIRS, sums=sums)


@query(f"WITH {order_states_sql(8)}, {_GH}, {_CELLS}, {_newton_sql('5.0')} SELECT f0, f1, excess, gain, CAST(row_number() OVER (ORDER BY excess DESC, gain DESC, list_position({_POS}, f0) DESC, list_position({_POS}, f1) DESC) AS INTEGER) AS rank FROM e QUALIFY rank <= 4")
def pair_rank_newton(spark, sf_dir):
    """Pairs by Newton gain beyond the better of their two features."""
    _, one, two = _gradient_cells(spark, sf_dir)
    scored = rank.with_marginals(stats.newton_gain(two, ["f0", "f1"]), stats.newton_gain(one, ["feature"]), "gain")
    return rank.top_pairs(scored, STATES, "excess", 4, "gain").select("f0", "f1", "excess", "gain", "rank")


@query(f"WITH {order_states_sql(8)}, {_GH}, {_CELLS}, {_newton_sql('5.0')}, x AS ({LONG}), xp AS ({LONG_PAIRS}), m1 AS ({_MI1}), m2 AS ({_MI2}), e2 AS (SELECT m2.f0, m2.f1, round(m2.mi - greatest(a.mi, b.mi), 9) AS mi_excess FROM m2 JOIN m1 a ON a.feature = f0 JOIN m1 b ON b.feature = f1), k AS (SELECT f0, f1, excess FROM e ORDER BY excess DESC, list_position({_POS}, f0) DESC, list_position({_POS}, f1) DESC LIMIT 4) SELECT f0, f1, excess, mi_excess, CAST(row_number() OVER (ORDER BY mi_excess DESC, list_position({_POS}, f0) DESC, list_position({_POS}, f1) DESC) AS INTEGER) AS rank FROM k JOIN e2 USING (f0, f1) QUALIFY rank <= 2")
def pair_rank_prefilter(spark, sf_dir):
    """The best pairs by Newton gain, of those the best by information."""
    df, one, two = _gradient_cells(spark, sf_dir)
    newton = rank.with_marginals(stats.newton_gain(two, ["f0", "f1"]), stats.newton_gain(one, ["feature"]), "gain")
    single = stats.mutual_information(stats.state_cells(df, STATES, ["y"]), ["feature"], ["state"], "y")
    pair = stats.mutual_information(stats.tuple_cells(df, PAIRS, ["y"]), ["f0", "f1"], ["s0", "s1"], "y")
    mi = rank.with_marginals(pair, single, "mi").select("f0", "f1", F.col("excess").alias("mi_excess"))
    return rank.two_stage(newton.join(mi, ["f0", "f1"]), STATES, "excess", "mi_excess", 2, 2).select("f0", "f1", "excess", "mi_excess", "rank")


@query(f"WITH {order_states_sql(8)}, {_GH}, {_CELLS}, l AS (SELECT unnest([1.0, 5.0, 20.0]::DOUBLE[]) AS l2) SELECT l2, f0, f1, round(sum(g * g / (h + l2)) / 2, 6) AS gain FROM c2, l GROUP BY 1, 2, 3")
def lambda_sweep_pair_gain(spark, sf_dir):
    """Gains of all pairs for several penalties from one table of cells."""
    _, _, two = _gradient_cells(spark, sf_dir)
    swept = two.withColumn("l2", F.explode(F.array(*map(F.lit, [1.0, 5.0, 20.0]))))
    return swept.groupBy("l2", "f0", "f1").agg(F.round(F.sum(F.col("g") ** 2 / (F.col("h") + F.col("l2"))) / 2, 6).alias("gain"))


@query(f"WITH th AS (SELECT {_LINE_CUTS}), x AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS feature, {state_sql(c, f't_{c}')} AS state, l_extendedprice * (1 - l_discount) AS v FROM lineitem, th' for c in LINE)}), c AS (SELECT feature, state, count(*) AS n, sum(v) AS v, sum(v * v) AS vv FROM x GROUP BY 1, 2) SELECT feature, round((sum(v * v / n) - sum(v) * sum(v) / sum(n)) / (sum(vv) - sum(v) * sum(v) / sum(n)), 7) AS eta2 FROM c GROUP BY 1")
def eta2_feature_rank(spark, sf_dir):
    """Share of the variance of net price that each column's states explain."""
    df = table(spark, sf_dir, "lineitem").select(*LINE, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    cuts = quantiles.nested_thresholds(df, LINE, (8,), digits=9)
    cells = stats.state_cells(df.select("v", *[fn.state(F.col(c), cuts[c][8]).alias(c) for c in LINE]), LINE, sums={"v": F.col("v"), "vv": F.col("v") ** 2})
    return rounded(stats.between_share(cells, ["feature"]), 7)


@query(f"WITH {order_states_sql(4)}, x AS ({LONG}), xp AS ({LONG_PAIRS}), c1 AS (SELECT feature, state, count(*) AS n, sum(price) AS v, sum(price * price) AS vv FROM x GROUP BY 1, 2), c2 AS (SELECT f0, f1, s0, s1, count(*) AS n, sum(price) AS v, sum(price * price) AS vv FROM xp GROUP BY 1, 2, 3, 4), e1 AS (SELECT feature, (sum(v * v / n) - sum(v) * sum(v) / sum(n)) / (sum(vv) - sum(v) * sum(v) / sum(n)) AS e FROM c1 GROUP BY 1), e2 AS (SELECT f0, f1, (sum(v * v / n) - sum(v) * sum(v) / sum(n)) / (sum(vv) - sum(v) * sum(v) / sum(n)) AS e FROM c2 GROUP BY 1, 2), r AS (SELECT f0, f1, round(e2.e - (a.e + b.e), 9) AS excess FROM e2 JOIN e1 a ON a.feature = f0 JOIN e1 b ON b.feature = f1) SELECT f0, f1, round(excess, 7) AS excess, CAST(row_number() OVER (ORDER BY excess DESC, list_position({_POS}, f0), list_position({_POS}, f1)) AS INTEGER) AS rank FROM r")
def eta2_pair_rank(spark, sf_dir):
    """Pairs by the variance of price they explain beyond both features."""
    df = order_states(spark, sf_dir)
    sums = {"v": F.col("price"), "vv": F.col("price") ** 2}
    one = stats.between_share(stats.state_cells(df, STATES, sums=sums), ["feature"])
    two = stats.between_share(stats.tuple_cells(df, PAIRS, sums=sums), ["f0", "f1"])
    top = rank.top_pairs(rank.with_marginals(two, one, "eta2", "sum"), STATES, "excess", 6, later_first=False)
    return top.select("f0", "f1", F.round("excess", 7).alias("excess"), "rank")


@query(f"WITH {order_states_sql(4)}, xp AS ({LONG_PAIRS}), c AS (SELECT f0, f1, s0, s1, count(*) AS n, sum(balance_) AS v FROM (SELECT xp.*, oc.balance AS balance_ FROM xp JOIN oc USING (o_orderkey)) GROUP BY 1, 2, 3, 4), d AS (SELECT *, v / n - sum(v) OVER (PARTITION BY f0, f1, s0) / sum(n) OVER (PARTITION BY f0, f1, s0) - sum(v) OVER (PARTITION BY f0, f1, s1) / sum(n) OVER (PARTITION BY f0, f1, s1) + sum(v) OVER (PARTITION BY f0, f1) / sum(n) OVER (PARTITION BY f0, f1) AS d FROM c) SELECT f0, f1, round(sum(n * d * d) / sum(n), 3) AS score FROM d GROUP BY 1, 2")
def anova_interaction(spark, sf_dir):
    """Interaction of pairs in the balance."""
    cells = stats.tuple_cells(order_states(spark, sf_dir), PAIRS, sums={"v": F.col("balance")})
    return rounded(stats.interaction_anova(cells), 3)


@query(f"WITH {order_states_sql(8)}, x AS ({LONG}), m AS ({mi_sql('SELECT * FROM x', 'feature', 'state', 'status')}) SELECT feature, round(mi, 8) AS mi FROM m")
def multiclass_mi(spark, sf_dir):
    """Information of each feature about the three statuses."""
    cells = stats.state_cells(order_states(spark, sf_dir, 8), STATES, ["status"])
    return rounded(stats.mutual_information(cells, ["feature"], ["state"], "status"), 8)


@query("WITH d AS (SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)), x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS state, '{y}' AS label, {y} AS t FROM d" for f in ("lang", "source") for y in ("quality", "toxic")) + f"), m AS ({mi_sql('SELECT * FROM x', 'feature, label', 'state', 't')}), v AS (SELECT label FROM x GROUP BY 1 HAVING count(DISTINCT t) > 1) SELECT feature, round(avg(mi), 8) AS mi FROM m JOIN v USING (label) GROUP BY 1")
def multilabel_mi(spark, sf_dir):
    """Mean information of language and source about two labels."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("state"), F.lit(y).alias("label"), F.col(y).alias("t")) for f in ("lang", "source") for y in ("quality", "toxic")])).alias("e")).select("e.*")
    cells = long.groupBy("feature", "state", "label", "t").agg(F.count("*").alias("n"))
    return rounded(stats.mean_label_information(cells, ["feature"], ["state"], "label", "t"), 8)


_DIRECTED = [(a, b) for a in STATES for b in STATES if a != b]
_DGH = " UNION ALL ".join(f"SELECT '{a}' AS f0, '{b}' AS f1, {a} AS s0, {b} AS s1, g, h, o_orderkey FROM gh" for a, b in _DIRECTED)


@query(f"WITH {order_states_sql(8)}, {_GH}, c AS (SELECT f0, f1, s0, s1, count(*) AS n, sum(g) AS g, sum(h) AS h FROM ({_DGH}) GROUP BY 1, 2, 3, 4), b AS (SELECT f0, f1, s0 AS gate_state, greatest(sum(g * g / (h + 5)) - sum(g) * sum(g) / (sum(h) + 5), 0) / 2 AS gain, CAST(sum(n) AS BIGINT) AS support, count(*) AS active, sum(h) AS hh FROM c GROUP BY 1, 2, 3) SELECT f0, f1, gate_state, round(gain, 6) AS gain, support FROM b WHERE support >= greatest(20, ceil(0.05 * (SELECT count(*) FROM st))) AND hh >= 1 AND active > 1")
def block_gain_full(spark, sf_dir):
    """Conditional blocks of all directed pairs."""
    df = order_states(spark, sf_dir, 8)
    n, p = df.agg(F.count("*"), F.avg("y")).first()
    cells = stats.tuple_cells(df, _DIRECTED, sums={"g": F.col("y") - p, "h": F.lit(p * (1 - p))})
    return rounded(stats.block_gains(cells, n).select("f0", "f1", "gate_state", "gain", "support"))


@query(f"WITH {order_states_sql(8)}, {_GH}, c AS (SELECT f0, f1, s0, s1, CAST((o_orderkey * 7919) % 1000003 % 2 AS INTEGER) AS half, count(*) AS n, sum(g) AS g, sum(h) AS h FROM ({_DGH}) GROUP BY ALL), b AS (SELECT half, f0, f1, s0 AS gate_state, greatest(sum(g * g / (h + 5)) - sum(g) * sum(g) / (sum(h) + 5), 0) / 2 AS gain FROM c GROUP BY 1, 2, 3, 4 HAVING sum(n) >= 10 AND sum(h) >= 1 AND count(*) > 1), w AS (SELECT f0, f1, gate_state, max(gain) FILTER (WHERE half = 0) AS a, max(gain) FILTER (WHERE half = 1) AS b FROM b GROUP BY 1, 2, 3) SELECT f0, f1, gate_state, round(2 * a * b / (a + b) * sqrt(least(a, b) / greatest(a, b)) / sqrt(64.0), 6) AS score FROM w WHERE a > 0 AND b > 0")
def block_gain_stable(spark, sf_dir):
    """Conditional blocks that hold in both halves of the keys."""
    df = order_states(spark, sf_dir, 8).withColumn("half", F.pmod(scramble(F.col("o_orderkey")), F.lit(2)).cast("int"))
    p = df.agg(F.avg("y")).first()[0]
    cells = stats.tuple_cells(df, _DIRECTED, ["half"], sums={"g": F.col("y") - p, "h": F.lit(p * (1 - p))})
    gains = stats.block_gains(cells, 0, least=10, by=["half"])
    w = gains.groupBy("f0", "f1", "gate_state").agg(F.max(F.when(F.col("half") == 0, F.col("gain"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("gain"))).alias("b")).where("a > 0 AND b > 0")
    return w.select("f0", "f1", "gate_state", F.round(stats.stable_score(F.col("a"), F.col("b"), 8), 6).alias("score"))


@query(f"WITH {order_states_sql(4)}, p AS (SELECT avg(y) AS p FROM st), c AS (SELECT s_day AS s, sum(p * (1 - p)) AS h FROM st, p WHERE s_price = 1 GROUP BY 1), q AS (SELECT s, h / sum(h) OVER () AS pi, sum(h) OVER () AS hh FROM c), r AS (SELECT *, sqrt(hh * pi * (1 - pi) / (hh * pi * (1 - pi) + 10)) AS scale FROM q) SELECT o_orderkey, s AS target_state, round(CASE WHEN s_price = 1 THEN (CAST(s_day = s AS INTEGER) - pi) * scale ELSE 0 END, 9) AS value FROM st, r WHERE s < 3")
def block_effect_columns(spark, sf_dir):
    """Centred and scaled columns of one conditional block (gate: price in state 1, target: day)."""
    df = order_states(spark, sf_dir)
    p = df.agg(F.avg("y")).first()[0]
    cells = {r["s_day"]: r["n"] * p * (1 - p) for r in df.where("s_price = 1").groupBy("s_day").agg(F.count("*").alias("n")).collect()}
    mass = sum(cells.values())
    columns = []
    for s in range(3):
        pi = cells.get(s, 0.0) / mass
        v = mass * pi * (1 - pi)
        value = F.when(F.col("s_price") == 1, ((F.col("s_day") == s).cast("int") - pi) * (v / (v + 10)) ** 0.5).otherwise(0.0)
        columns.append(F.struct(F.lit(s).alias("target_state"), F.round(value, 9).alias("value")))
    return df.select("o_orderkey", F.explode(F.array(*columns)).alias("e")).select("o_orderkey", "e.*")


_R16 = fn.residual_map([s * 4 // 16 for s in range(16)])


@query(f"WITH th AS (SELECT {cuts_sql('c_acctbal', 'customer', 16)} AS t), s AS (SELECT c_custkey, {state_sql('c_acctbal', 't')} AS s16 FROM customer, th) SELECT c_custkey, CAST(s16 // 4 AS INTEGER) AS coarse, CAST(CASE WHEN s16 % 4 = 0 THEN 0 ELSE s16 - s16 // 4 END AS INTEGER) AS residual FROM s")
def residual_codes(spark, sf_dir):
    """Balance as a coarse state and the residual code of its fine state."""
    df = table(spark, sf_dir, "customer")
    fine = fn.state(F.col("c_acctbal"), quantiles.nested_thresholds(df, ["c_acctbal"], (16,), digits=9)["c_acctbal"][16])
    return df.select("c_custkey", fine.alias("s16")).select("c_custkey", fn.coarser(F.col("s16"), 16, 4).alias("coarse"), fn.lookup(F.col("s16"), _R16).cast("int").alias("residual"))


@query(f"WITH {order_states_sql(4)}, x AS ({LONG}) SELECT o_orderkey, CAST((list_position({_POS}, feature) - 1) * 3 + state - 1 AS INTEGER) AS slot FROM x WHERE state > 0")
def reference_one_hot(spark, sf_dir):
    """The one-hot columns in use of each row, state 0 being the reference."""
    df = order_states(spark, sf_dir)
    slots = F.array(*[F.when(F.col(s) > 0, F.lit(i * 3) + F.col(s) - 1) for i, s in enumerate(STATES)])
    return df.select("o_orderkey", F.explode(F.filter(slots, lambda v: v.isNotNull())).alias("slot"))


@query(f"WITH {OC}, r AS (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY (o_orderkey * 7919 + 1) % 1000003, o_orderkey) AS k, count(*) OVER (PARTITION BY y) AS n FROM oc) SELECT o_orderkey, y FROM r WHERE k <= greatest(8, ceil(n * 0.1))")
def stratified_subsample_rows(spark, sf_dir):
    """A tenth of each class, by key."""
    return stratified_subsample(order_features(spark, sf_dir), "o_orderkey", "y", 0.1, seed=1).select("o_orderkey", "y")


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) <= 1e-12 THEN 1.0 ELSE stddev_pop({c}) END AS scale FROM lineitem" for c in LINE) + ") SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM m")
def linear_standardize(spark, sf_dir):
    """Mean and population deviation of the columns that enter linearly."""
    df = table(spark, sf_dir, "lineitem")
    row = df.agg(*[F.avg(c) for c in LINE], *[F.stddev_pop(c) for c in LINE]).first()
    return spark.createDataFrame([(c, round(row[i], 6), round(row[i + 4] if row[i + 4] > 1e-12 else 1.0, 6)) for i, c in enumerate(LINE)], "feature string, mean double, scale double")


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings) SELECT dim, round(avg(x), 7) AS mean, round(CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0 ELSE stddev_pop(x) END, 7) AS scale FROM x GROUP BY 1")
def embedding_scale(spark, sf_dir):
    """Mean and deviation of each embedding component."""
    return rounded(adapt.embedding_scale(table(spark, sf_dir, "embeddings"), "embedding"), 7)


@query("WITH x AS (SELECT vec_id, label < 5 AS c, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), m AS (SELECT dim, avg(x) FILTER (WHERE NOT c) AS m0, avg(x) FILTER (WHERE c) AS m1 FROM x GROUP BY 1) SELECT vec_id, round(sum((x - m0) * (x - m0)) - sum((x - m1) * (x - m1)), 6) AS direction FROM x JOIN m USING (dim) GROUP BY 1")
def centroid_direction(spark, sf_dir):
    """How much nearer each embedding is to the second class's centroid than to the first's."""
    df = table(spark, sf_dir, "embeddings").withColumn("c", (F.col("label") < 5).cast("int"))
    centre: dict[int, dict[int, float]] = {0: {}, 1: {}}
    for r in adapt.class_centroids(df, "embedding", "c").collect():
        centre[r["class"]][r["dim"]] = r["mean"]
    centroids = {c: [v[i] for i in range(len(v))] for c, v in centre.items()}
    return df.select("vec_id", F.round(adapt.centroid_direction(df, "embedding", centroids), 6).alias("direction"))


@query("WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id, e.vec_id AS other, e.label < 5 AS y, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9) AS d2 FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) <= 5) SELECT vec_id, round(sum(y::INTEGER / (sqrt(d2) + 1e-9)) / sum(1 / (sqrt(d2) + 1e-9)), 6) AS probability FROM k GROUP BY 1")
def knn_density(spark, sf_dir):
    """Distance-weighted class share among the five nearest embeddings, for every twentieth vector."""
    df = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return rounded(adapt.knn_probability(df, "vec_id", "embedding", "y", F.col("vec_id") % 20 == 0))


# losses and thresholds --------------------------------------------------------------------------------------------


@query(f"WITH {OC}, p AS (SELECT y, 0.1 + 0.8 * day / 31 AS p FROM oc), l AS (SELECT -(y * ln(p) + (1 - y) * ln(1 - p)) AS l FROM p) SELECT round(avg(l), 8) AS loss, round(stddev_samp(l) / sqrt(count(l)), 8) AS standard_error FROM l")
def log_loss_error(spark, sf_dir):
    """Log loss of a fixed score with its standard error."""
    df = order_features(spark, sf_dir).withColumn("p", 0.1 + 0.8 * F.col("day") / 31)
    return rounded(stats.mean_and_error(df, stats.log_loss(F.col("y"), F.col("p"))), 8)


@query("WITH c AS (SELECT round(l_discount * 5, 6) + l_tax AS t, count(*) AS n, sum(CAST(l_returnflag = 'R' AS INTEGER)) AS p FROM lineitem GROUP BY 1), f AS (SELECT t, 2 * sum(p) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) / (sum(n) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) + sum(p) OVER ()) AS f1 FROM c) SELECT round(0.125 + 0.75 * greatest(least(t, 0.95), 0.05), 8) AS threshold, round(f1, 8) AS f1 FROM f ORDER BY f1 DESC, t DESC LIMIT 1")
def best_f1_threshold(spark, sf_dir):
    """The threshold with the best F1, drawn towards a half."""
    df = table(spark, sf_dir, "lineitem").select((F.round(F.col("l_discount") * 5, 6) + F.col("l_tax")).alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(stats.best_f1_threshold(df, "t", "y"), 8)


@query(f"WITH {OC} SELECT round(avg(y), 8) AS mean, round(avg(y) - sqrt(2 * var_samp(y) * ln(2 / 0.05) / count(y)) - 7 * ln(2 / 0.05) / (3 * (count(y) - 1)), 8) AS lower FROM oc")
def bernstein_lcb(spark, sf_dir):
    """A lower confidence bound of the share of finished orders."""
    return rounded(stats.bernstein_bound(order_features(spark, sf_dir), F.col("y").cast("double"), 1.0), 8)


@query("WITH g AS (SELECT l_quantity AS a, l_tax AS b, l_discount AS c FROM lineitem) SELECT * FROM (SELECT 'n' AS term, CAST(count(*) AS DOUBLE) AS value FROM g UNION ALL SELECT 'ab', round(sum(a * b), 3) FROM g UNION ALL SELECT 'bc', round(sum(b * c), 3) FROM g UNION ALL SELECT 'aa', round(sum(a * a), 3) FROM g)")
def gram_terms(spark, sf_dir):
    """Entries of the Gram matrix of three columns."""
    g = stats.gram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax", "l_discount"])
    return spark.createDataFrame([("n", float(g[0][0])), ("ab", round(g[1][2], 3)), ("bc", round(g[2][3], 3)), ("aa", round(g[1][1], 3))], "term string, value double")


@query(f"WITH {order_states_sql(4)}, x AS ({LONG}), m AS ({mi_sql('SELECT * FROM x', 'feature', 'state', 'y')}), r AS (SELECT 'y' AS d, feature, row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS r FROM m UNION ALL SELECT 'status', feature, row_number() OVER (ORDER BY feature) FROM m), f AS (SELECT feature, min((r, d)) AS m FROM r GROUP BY 1) SELECT feature, CAST(row_number() OVER (ORDER BY m, feature) AS INTEGER) AS rank FROM f QUALIFY rank <= 3")
def quota_features(spark, sf_dir):
    """Features in turn from two rankings."""
    m = stats.mutual_information(stats.state_cells(order_states(spark, sf_dir), STATES, ["y"]), ["feature"], ["state"], "y")
    one = m.select(F.lit("y").alias("d"), "feature", F.row_number().over(Window.orderBy(F.desc(F.round("mi", 9)), "feature")).alias("r"))
    two = m.select(F.lit("status").alias("d"), "feature", F.row_number().over(Window.orderBy("feature")).alias("r"))
    return rank.round_robin(one.unionByName(two), "d", "r", "feature", 3)


@query("SELECT o_orderpriority AS priority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3")
def top_in_group(spark, sf_dir):
    """The three dearest orders of each priority."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_orderkey", "o_totalprice")
    return rank.top_in_group(df, "priority", "o_totalprice", ["o_orderkey"], 3).select("priority", "o_orderkey", "rank")


@query("WITH r AS (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS k FROM part) SELECT p_partkey, p_size FROM r WHERE k <= 5")
def tie_safe_top(spark, sf_dir):
    """The five largest parts and all that tie with the fifth."""
    return rank.tie_safe_top(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 5)


@query(f"WITH {order_states_sql(16)} SELECT s_price AS fine, CAST(min(least(floor(s_price * 4 / 16), 3)) AS INTEGER) AS low, CAST(max(least(floor(s_price * 4 / 16), 3)) AS INTEGER) AS high FROM st GROUP BY 1")
def gate_map(spark, sf_dir):
    """Whether the coarse state is a function of the fine one, on the rows there are."""
    df = order_states(spark, sf_dir, 16).withColumn("coarse", fn.coarser(F.col("s_price"), 16, 4))
    return df.groupBy(F.col("s_price").alias("fine")).agg(F.min("coarse").alias("low"), F.max("coarse").alias("high"))


# programs and fits ------------------------------------------------------------------------------------------------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def frozen_program(link: str = "logit") -> Program:
    """A program with fixed thresholds and tables, of every kind of term."""
    features = {
        "num:price": Feature("num:price", "numeric", "price", 4, 150000.0, [50000.0, 150000.0, 250000.0]),
        "num:balance": Feature("num:balance", "numeric", "balance", 3, 0.0, [0.0, 5000.0]),
        "catid:priority": Feature("catid:priority", "category", "priority", 6, values=PRIORITIES),
        "num:day": Feature("num:day", "numeric", "day", 2, 15.0, [15.0]),
    }
    return Program(
        features,
        0.25,
        [("num:price", [0.0, 0.5, -0.25, 1.0]), ("num:balance", [0.0, -0.5, 0.75]), ("catid:priority", [0.0, 0.1, 0.2, 0.3, 0.4, -1.0]), ("num:day", [0.0, 0.0])],
        [("num:price", "num:balance", [[0.0, 0.1, 0.2], [0.0, 0.3, -0.3], [0.0, 0.0, 0.6], [0.0, -0.2, 0.1]]), ("num:balance", "num:price", [[0.05, 0.0, 0.0, 0.1], [0.0, 0.0, 0.2, 0.0], [0.0, 0.4, 0.0, 0.0]])],
        [("month", 6.0, 6.5, 3.5, 0.2)],
        link,
    )


def _case(name: str, table: list[float]) -> str:
    return "CASE " + name + " " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(table)) + " ELSE 0 END"


_P = frozen_program()
_STATES_SQL = f"{OC}, z AS (SELECT oc.*, CAST(price >= 50000 AS INTEGER) + CAST(price >= 150000 AS INTEGER) + CAST(price >= 250000 AS INTEGER) AS a, CAST(balance >= 0 AS INTEGER) + CAST(balance >= 5000 AS INTEGER) AS b, coalesce(list_position({PRIORITIES}, priority) - 1, 5) AS c FROM oc)"
_SCORE = f"0.25 + {_case('a', _P.unary[0][1])} + {_case('b', _P.unary[1][1])} + {_case('c', _P.unary[2][1])} + {_case('a * 3 + b', [v for r in _P.pairs[0][2] for v in r])} + {_case('b * 4 + a', [v for r in _P.pairs[1][2] for v in r])} + (month - 6.5) / 3.5 * 0.2"
_SCORED = f"WITH {_STATES_SQL}, s AS (SELECT o_orderkey, {_SCORE} AS score FROM z) SELECT o_orderkey, round(score, 9) AS score, round(1 / (1 + exp(-score)), 9) AS probability FROM s"


def _scored(df: DataFrame, program: Program) -> DataFrame:
    z = program.score()
    return df.select("o_orderkey", F.round(z, 9).alias("score"), F.round(fn.sigmoid(z), 9).alias("probability"))


@query(_SCORED)
def score_program_semantic(spark, sf_dir):
    """Scores of the fixed program as it was built."""
    return _scored(order_features(spark, sf_dir), frozen_program())


@query(_SCORED)
def score_program_optimized(spark, sf_dir):
    """The same scores from the rewritten program."""
    return _scored(order_features(spark, sf_dir), optimised(frozen_program()))


def _q16(table: list[float]) -> list[float]:
    q, scale, _ = fn.quantise(table)
    return [v * scale for v in q]


_SCORE16 = f"0.25 + {_case('a', _q16(_P.unary[0][1]))} + {_case('b', _q16(_P.unary[1][1]))} + {_case('c', _q16(_P.unary[2][1]))} + {_case('a * 3 + b', _q16([v for r in _P.pairs[0][2] for v in r]))} + {_case('b * 4 + a', _q16([v for r in _P.pairs[1][2] for v in r]))} + (month - 6.5) / 3.5 * 0.2"


@query(f"WITH {_STATES_SQL}, s AS (SELECT o_orderkey, {_SCORE16} AS score FROM z) SELECT o_orderkey, round(score, 9) AS score FROM s")
def score_int16(spark, sf_dir):
    """Scores from tables in 16-bit fixed point."""
    return order_features(spark, sf_dir).select("o_orderkey", F.round(frozen_program().quantised().score(), 9).alias("score"))


@query(f"WITH {_STATES_SQL}, s AS (SELECT o_orderkey, {_SCORE} AS u, 2 * ({_SCORE}) - 1 AS v FROM z), e AS (SELECT o_orderkey, exp(greatest(u - greatest(u, v, 0), -50)) AS a, exp(greatest(v - greatest(u, v, 0), -50)) AS b, exp(greatest(0 - greatest(u, v, 0), -50)) AS c FROM s) SELECT o_orderkey, round(a / (a + b + c), 9) AS p0, round(b / (a + b + c), 9) AS p1, round(c / (a + b + c), 9) AS p2, CASE WHEN a >= b AND a >= c THEN 'x' WHEN b >= c THEN 'y' ELSE 'z' END AS prediction FROM e")
def ovr_softmax_scores(spark, sf_dir):
    """Three heads coupled by a softmax, and the class."""
    p = frozen_program("identity")
    bundle = Bundle([p, p.calibrated(2.0, -1.0), Program({})], "softmax", ["x", "y", "z"])
    out = bundle.transform(order_features(spark, sf_dir))
    return out.select("o_orderkey", *[F.round(F.col("probabilities")[i], 9).alias(f"p{i}") for i in range(3)], "prediction")


@query(f"WITH {_STATES_SQL}, s AS (SELECT o_orderkey, 1 / (1 + exp(-({_SCORE}))) AS p FROM z) SELECT o_orderkey, round(p, 9) AS p0, CAST(0.000001 AS DOUBLE) AS p1, CAST(p >= 0.6 AS INTEGER) AS l0, 0 AS l1 FROM s")
def multilabel_threshold(spark, sf_dir):
    """Two labels, one of them constant, with thresholds of their own."""
    bundle = Bundle([frozen_program(), constant_program(0.0)], "labels", ["a", "b"], [0.6, 0.5])
    out = bundle.transform(order_features(spark, sf_dir))
    return out.select("o_orderkey", *[F.round(F.col("probabilities")[i], 9).alias(f"p{i}") for i in range(2)], *[F.col("prediction")[i].alias(f"l{i}") for i in range(2)])


@query("WITH s AS (SELECT o_orderkey, 1 - 0.3 * least(o_totalprice / 500000, 1) AS a, 0.6 - 0.5 * least(o_totalprice / 500000, 1) AS b FROM orders) SELECT o_orderkey, round(-2 + 0.5 * (1 + a) + 1 * (a + b) + 0.5 * b, 9) AS mean FROM s")
def survival_integral(spark, sf_dir):
    """The mean of a distribution from survival probabilities at two thresholds."""
    x = F.least(F.col("o_totalprice") / 500000, F.lit(1.0))
    mean = fn.survival_mean(-2.0, [-1.0, 1.0], 2.0, [1 - 0.3 * x, 0.6 - 0.5 * x])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(mean, 9).alias("mean"))


@query("SELECT c_custkey, round(c_acctbal, 6) AS q0, round(greatest(c_acctbal, c_acctbal * 0.5 + 100), 6) AS q1, round(greatest(c_acctbal, c_acctbal * 0.5 + 100, 2000 - c_acctbal), 6) AS q2 FROM customer")
def non_crossing_quantiles(spark, sf_dir):
    """Quantile predictions raised so that they don't cross."""
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", *[F.round(q, 6).alias(f"q{i}") for i, q in enumerate(fn.running_max([b, b * 0.5 + 100, 2000 - b]))])


@query("WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_quantity, l_tax) AS c, corr(l_extendedprice, l_discount) AS d, corr(l_extendedprice, l_tax) AS e, corr(l_discount, l_tax) AS f FROM lineitem) SELECT round(4.0 + 2 * (a*a + b*b + c*c + d*d + e*e + f*f), 6) AS square_sum, 4.0 AS trace FROM c")
def output_spectrum_moments(spark, sf_dir):
    """First two moments of the spectrum of four outputs' correlations."""
    df = table(spark, sf_dir, "lineitem")
    g = stats.gram(df, LINE)
    values, _, _ = solve.output_spectrum(np.array(g), g[0][0])
    return spark.createDataFrame([(round(float((values**2).sum()), 6), round(float(values.sum()), 6))], "square_sum double, trace double")


@query(f"WITH {OC}, m AS (SELECT avg(y) AS p FROM oc) SELECT o_orderkey, round(p - y, 9) AS g, round(p * (1 - p), 9) AS h FROM oc, m")
def logistic_gradients(spark, sf_dir):
    """Gradient and Hessian of the log loss at the constant model."""
    df = order_features(spark, sf_dir)
    p = df.agg(F.avg("y")).first()[0]
    return df.select("o_orderkey", F.round(F.lit(p) - F.col("y"), 9).alias("g"), F.lit(round(p * (1 - p), 9)).alias("h"))


@query("WITH s AS (SELECT sum(l_quantity * l_quantity) AS xx, sum(l_quantity) AS x, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice) AS y, count(*) AS n FROM lineitem), b AS (SELECT (xy - x * y / n) / (xx - x * x / n + 1.0) AS b, * FROM s) SELECT round(b, 5) AS slope, round((y - b * x) / n, 4) AS intercept FROM b")
def ridge_closed_form(spark, sf_dir):
    """Ridge regression of price on quantity from one Gram matrix."""
    g = np.array(stats.gram(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]))
    w = solve.ridge_from_gram(g[:2, :2], g[:2, 2:], 1.0)
    return spark.createDataFrame([(round(float(w[1, 0]), 5), round(float(w[0, 0]), 4))], "slope double, intercept double")


ORDER_COLUMNS = ["price", "balance", "day", "month", "priority", "segment"]
SMALL = {"bins": 8, "pair_features": 4, "max_pairs": 2, "max_features": 6}


@query()
def fit_classifier(spark, sf_dir):
    """A binary classifier of finished orders: key, probability, class."""
    df = kept_features(spark, sf_dir)
    model = StateClassifier(**SMALL).fit(df, ORDER_COLUMNS, "y", "o_orderkey")
    return model.predict(df.select("o_orderkey", *ORDER_COLUMNS)).select("o_orderkey", "probability", "prediction")


@query()
def fit_multiclass(spark, sf_dir):
    """Status of orders by a softmax on shared structure."""
    df = kept_features(spark, sf_dir)
    model = SharedClassifier(**SMALL).fit(df, ORDER_COLUMNS, "status", "o_orderkey")
    return model.predict(df.select("o_orderkey", *ORDER_COLUMNS)).select("o_orderkey", "probabilities", "prediction")


@query()
def fit_multilabel(spark, sf_dir):
    """Quality and toxicity of documents from language, source and length."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    model = MultiLabelClassifier(**SMALL).fit(df, ["lang", "source", "n_chars"], ["quality", "toxic"], "doc_id")
    return model.predict(df.select("doc_id", "lang", "source", "n_chars")).select("doc_id", "probabilities", "prediction")


@query()
def fit_ridge(spark, sf_dir):
    """Prices of orders by the finite-state ridge regression."""
    df = kept_features(spark, sf_dir)
    features = ["balance", "day", "month", "priority", "segment", "status"]
    model = StateRidgeRegressor(**SMALL).fit(df, features, "price", "o_orderkey")
    return model.predict(df.select("o_orderkey", *features)).select("o_orderkey", "prediction")


@query()
def fit_fused(spark, sf_dir):
    """Prices of orders by the fused residual regression."""
    df = kept_features(spark, sf_dir)
    features = ["balance", "day", "month", "priority", "segment", "status"]
    model = FusedRegressor(**(SMALL | {"thresholds": 4})).fit(df, features, "price", "o_orderkey")
    return model.predict(df.select("o_orderkey", *features)).select("o_orderkey", "prediction")


@query()
def fit_poisson(spark, sf_dir):
    """Events of each user by a Poisson model of the mean value and the number of types."""
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.count_distinct("event_type").alias("types"))
    model = GeneralizedRegressor(loss="poisson", bins=8).fit(df, ["mean_value", "types"], "n", "user_id")
    return model.predict(df.select("user_id", "mean_value", "types")).select("user_id", "prediction")


@query()
def fit_quantiles(spark, sf_dir):
    """Three quantiles of prices of orders, which don't cross."""
    df = kept_features(spark, sf_dir)
    features = ["balance", "month", "priority"]
    model = GeneralizedRegressor(loss="quantile", quantiles=(0.1, 0.5, 0.9), bins=8).fit(df, features, "price", "o_orderkey")
    return model.predict(df.select("o_orderkey", *features)).select("o_orderkey", "prediction")


@query()
def fit_multioutput(spark, sf_dir):
    """Price and balance together from shared structure."""
    df = kept_features(spark, sf_dir)
    features = ["day", "month", "priority", "segment"]
    model = MultiOutputRegressor(bins=8).fit(df, features, ["price", "balance"], "o_orderkey")
    return model.predict(df.select("o_orderkey", *features)).select("o_orderkey", "prediction_price", "prediction_balance")


from . import queries_structure  # noqa: E402, F401  more entries of the catalogue
