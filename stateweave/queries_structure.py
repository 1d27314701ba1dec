"""More of the catalogue: structure search, class corrections, caches, blocks and embeddings, each with SQL where it can be."""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from . import functions as fn
from .keys import scramble
from .operators import adapt, cache, quantiles, rank, refine, stats
from .plans.program import Bundle, Program, SharedProgram, max_error
from .plans.rewrite import compacted, optimised
from .queries import NUMERIC, _CELLS, _DGH, _DIRECTED, _GH, _MI1, _MI2, _POS, _STATES_SQL, LONG, LONG_PAIRS, ORACLES, PAIRS, STATES, frozen_program, kept_features, mi_sql, order_states, order_states_sql, query, rounded
from .sources import order_features, table

_STATUS = ["F", "O", "P"]
_CLASS_LONG = " UNION ALL ".join(f"SELECT feature, state, '{c}' AS class, CAST(status = '{c}' AS DOUBLE) AS t, (SELECT avg(CAST(status = '{c}' AS DOUBLE)) FROM st) AS p FROM x" for c in _STATUS)
_CLASS_CELLS = f"x AS ({LONG}), cc AS (SELECT feature, state, class, count(*) AS n, sum(t - p) AS g, sum(p * (1 - p)) AS h FROM ({_CLASS_LONG}) GROUP BY ALL)"


def _class_cells(spark, sf_dir):
    df = order_states(spark, sf_dir, 8)
    shares = df.agg(*[F.avg((F.col("status") == c).cast("double")) for c in _STATUS]).first()
    df = df.withColumn("code", F.array_position(F.array(*map(F.lit, _STATUS)), F.col("status")) - 1)
    return stats.class_cells(df, STATES, _STATUS, "code", [F.lit(x) for x in shares])


@query(f"WITH {order_states_sql(8)}, {_CLASS_CELLS} SELECT feature, round(sum(g * g / (h + 10)) / 2, 6) AS gain FROM cc WHERE n >= 12 GROUP BY 1")
def class_state_gain(spark, sf_dir):
    """What each feature's states tell about the residuals of three classes."""
    return rounded(stats.class_gains(_class_cells(spark, sf_dir), ["feature"]))


@query(
    f"WITH {order_states_sql(8)}, {_CLASS_CELLS}, s AS (SELECT class, feature, state, round(g * g / (h + 10) / 2, 9) AS score FROM cc WHERE n >= 12), "
    f"o AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, list_position({_POS}, feature), state) AS k FROM s) "
    f"SELECT class, feature, state, score, CAST(row_number() OVER (ORDER BY score DESC, class, list_position({_POS}, feature), state) AS INTEGER) AS rank FROM o WHERE k <= 3 QUALIFY rank <= 7"
)
def class_delta_descriptors(spark, sf_dir):
    """The states that call most for a correction of one class: three a class, seven in all."""
    return stats.class_descriptors(_class_cells(spark, sf_dir), STATES, most=7)


def _labels_sql(how: str) -> str:
    over = {"mean": "avg({0})", "max": "max({0})", "mean_max": "(avg({0}) + max({0})) / 2"}[how]
    return f"SELECT '{how}' AS how, f0, f1, round({over.format('excess')}, 8) AS excess, round({over.format('mi')}, 8) AS mi FROM e GROUP BY f0, f1"


_TWO = ["y", "late"]
_LL = " UNION ALL ".join(f"SELECT x.feature, x.state, '{t}' AS label, {t} AS t FROM ({LONG.replace('y, status', 'y, CAST(month >= 7 AS INTEGER) AS late, status')}) x" for t in _TWO)
_LP = " UNION ALL ".join(f"SELECT x.f0, x.f1, x.s0, x.s1, '{t}' AS label, {t} AS t FROM ({LONG_PAIRS.replace('y, status', 'y, CAST(month >= 7 AS INTEGER) AS late, status')}) x" for t in _TWO)


@query(
    f"WITH {order_states_sql(4)}, m1 AS ({mi_sql(_LL, 'feature, label', 'state', 't')}), m2 AS ({mi_sql(_LP, 'f0, f1, label', 's0, s1', 't')}), "
    "e AS (SELECT m2.f0, m2.f1, m2.label, m2.mi - greatest(a.mi, b.mi) AS excess, m2.mi AS mi FROM m2 JOIN m1 a ON a.feature = f0 AND a.label = m2.label JOIN m1 b ON b.feature = f1 AND b.label = m2.label) "
    + " UNION ALL ".join(_labels_sql(h) for h in ("mean", "max", "mean_max"))
)
def label_pair_rank(spark, sf_dir):
    """Pairs by what they tell about two labels beyond their features: mean, largest, and half of each."""
    df = order_states(spark, sf_dir).withColumn("late", (F.col("month") >= 7).cast("int"))
    long = df.select(*STATES, F.explode(F.array(*[F.struct(F.lit(t).alias("label"), F.col(t).alias("t")) for t in _TWO])).alias("l")).select(*STATES, "l.*")
    one = stats.mutual_information(stats.state_cells(long, STATES, ["label", "t"]), ["feature", "label"], ["state"], "t")
    two = stats.mutual_information(stats.tuple_cells(long, PAIRS, ["label", "t"]), ["f0", "f1", "label"], ["s0", "s1"], "t")
    side = lambda f, name: F.broadcast(one.select(F.col("feature").alias(f), "label", F.col("mi").alias(name)))
    each = two.join(side("f0", "a"), ["f0", "label"]).join(side("f1", "b"), ["f1", "label"]).withColumn("excess", F.col("mi") - F.greatest("a", "b"))
    out = [rank.label_pairs(each, how).withColumn("how", F.lit(how)) for how in ("mean", "max", "mean_max")]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), 8)


@query(
    f"WITH {order_states_sql(4)}, x AS ({LONG}), xp AS ({LONG_PAIRS}), m1 AS ({mi_sql('SELECT * FROM x', 'feature', 'state', 'status')}), m2 AS ({mi_sql('SELECT * FROM xp', 'f0, f1', 's0, s1', 'status')}) "
    "SELECT m2.f0, m2.f1, round(m2.mi - greatest(a.mi, b.mi), 8) AS excess FROM m2 JOIN m1 a ON a.feature = f0 JOIN m1 b ON b.feature = f1"
)
def multiclass_pair_rank(spark, sf_dir):
    """Pairs by what they tell about the three statuses jointly."""
    df = order_states(spark, sf_dir)
    one = stats.mutual_information(stats.state_cells(df, STATES, ["status"]), ["feature"], ["state"], "status")
    two = stats.mutual_information(stats.tuple_cells(df, PAIRS, ["status"]), ["f0", "f1"], ["s0", "s1"], "status")
    return rounded(rank.with_marginals(two, one, "mi").select("f0", "f1", "excess"), 8)


_N1 = "n1 AS (SELECT feature, sum(g * g / (h + 5.0)) / 2 AS gain FROM c1 GROUP BY ALL), n2 AS (SELECT f0, f1, sum(g * g / (h + 5.0)) / 2 AS gain FROM c2 GROUP BY ALL)"


@query(
    f"WITH {order_states_sql(8)}, {_GH}, {_CELLS}, {_N1}, x AS ({LONG}), xp AS ({LONG_PAIRS}), m1 AS ({_MI1}), m2 AS ({_MI2}), "
    f"a AS (SELECT m2.f0, m2.f1, row_number() OVER (ORDER BY round(m2.mi - greatest(p.mi, q.mi), 9) DESC, round(m2.mi, 9) DESC, list_position({_POS}, m2.f0) DESC, list_position({_POS}, m2.f1) DESC) AS r FROM m2 JOIN m1 p ON p.feature = f0 JOIN m1 q ON q.feature = f1), "
    f"b AS (SELECT n2.f0, n2.f1, row_number() OVER (ORDER BY round(n2.gain - greatest(p.gain, q.gain), 9) DESC, round(n2.gain, 9) DESC, list_position({_POS}, n2.f0) DESC, list_position({_POS}, n2.f1) DESC) AS r FROM n2 JOIN n1 p ON p.feature = f0 JOIN n1 q ON q.feature = f1), "
    "u AS (SELECT f0, f1, 0 AS grp, r FROM a WHERE r <= 2 UNION ALL SELECT * FROM (SELECT f0, f1, 1 AS grp, r FROM b WHERE (f0, f1) NOT IN (SELECT (f0, f1) FROM a WHERE r <= 2) ORDER BY r LIMIT 1) UNION ALL SELECT f0, f1, 2, r FROM a WHERE r > 2), "
    "d AS (SELECT f0, f1, min((grp, r)) AS o FROM u GROUP BY 1, 2) SELECT f0, f1, CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS rank FROM d QUALIFY rank <= 3"
)
def pair_rank_diversified(spark, sf_dir):
    """Two pairs by information, one by Newton gain that the first two don't hold."""
    df = order_states(spark, sf_dir, 8)
    single = stats.mutual_information(stats.state_cells(df, STATES, ["y"]), ["feature"], ["state"], "y")
    pair = stats.mutual_information(stats.tuple_cells(df, PAIRS, ["y"]), ["f0", "f1"], ["s0", "s1"], "y")
    p = df.agg(F.avg("y")).first()[0]
    newton = cache.HistogramCache.newton(df, STATES, "y", F.lit(p)).top_pairs(5.0, 6)
    return rank.diversified(rank.top_pairs(rank.with_marginals(pair, single, "mi"), STATES, "excess", 6, "mi"), newton, 3)


_DAY = "0.1 + 0.8 * day / 31"


@query(
    f"WITH {order_states_sql(8)}, gh AS (SELECT st.*, y - ({_DAY}) AS g, ({_DAY}) * (1 - ({_DAY})) AS h FROM st), {_CELLS}, {_N1}, "
    f"e AS (SELECT n2.f0, n2.f1, round(n2.gain - greatest(a.gain, b.gain), 9) AS excess, round(n2.gain, 9) AS gain FROM n2 JOIN n1 a ON a.feature = f0 JOIN n1 b ON b.feature = f1) "
    f"SELECT f0, f1, round(excess, 6) AS excess, CAST(row_number() OVER (ORDER BY excess DESC, gain DESC, list_position({_POS}, f0) DESC, list_position({_POS}, f1) DESC) AS INTEGER) AS rank FROM e QUALIFY rank <= 4"
)
def pair_rank_residual(spark, sf_dir):
    """Pairs by Newton gain on the residuals of a given probability."""
    df = order_states(spark, sf_dir, 8)
    top = cache.HistogramCache.newton(df, STATES, "y", 0.1 + 0.8 * F.col("day") / 31).top_pairs(5.0, 4)
    return top.select("f0", "f1", F.round("excess", 6).alias("excess"), "rank")


_BLOCKS = (
    "c AS (SELECT f0, f1, s0, s1, count(*) AS n, sum(g) AS g, sum(h) AS h FROM (" + _DGH + ") GROUP BY 1, 2, 3, 4), "
    "b AS (SELECT f0, f1, s0 AS gate_state, greatest(sum(g * g / (h + 5)) - sum(g) * sum(g) / (sum(h) + 5), 0) / 2 AS gain, sum(n) AS support, count(*) AS active, sum(h) AS hh FROM c GROUP BY 1, 2, 3), "
    "k AS (SELECT f0, f1, gate_state, gain FROM b WHERE support >= greatest(20, ceil((SELECT count(*) FROM st) * 0.05)) AND hh >= 1 AND active > 1), "
)


@query(
    f"WITH {order_states_sql(8)}, {_GH}, {_BLOCKS} s AS (SELECT f0, f1, gate_state, round(gain, 9) AS gain, round((gain / (SELECT count(*) FROM st) - 80 * 1e-7 - 2 * 1e-6) / sqrt(80), 12) AS score FROM k WHERE gain / (SELECT count(*) FROM st) - 80 * 1e-7 - 2 * 1e-6 > 0) "
    f"SELECT f0, f1, gate_state, round(gain, 6) AS gain, CAST(row_number() OVER (ORDER BY score DESC, gain DESC, list_position({_POS}, f0) DESC, gate_state DESC, list_position({_POS}, f1) DESC) AS INTEGER) AS rank FROM s QUALIFY rank <= 8"
)
def block_rank_full(spark, sf_dir):
    """Conditional blocks by gain a row less their cost."""
    df = order_states(spark, sf_dir, 8)
    n, p = df.agg(F.count("*"), F.avg("y")).first()
    cells = stats.tuple_cells(df, _DIRECTED, sums={"g": F.col("y") - p, "h": F.lit(p * (1 - p))})
    scored = rank.cost_adjusted(stats.block_gains(cells, n), n, F.lit(8.0), 1e-7, 1e-6)
    return rank.top_blocks(scored, STATES, "score", 8).select("f0", "f1", "gate_state", F.round("gain", 6).alias("gain"), "rank")


_HALF = "CAST((o_orderkey * 7919) % 1000003 % 2 AS INTEGER)"


@query(
    f"WITH {order_states_sql(8)}, {_GH}, {_BLOCKS} f AS (SELECT 'full' AS kind, f0, f1, gate_state, round(gain, 9) AS gain, round(gain / (SELECT count(*) FROM st) / sqrt(80), 12) AS score FROM k), "
    f"ch AS (SELECT f0, f1, s0, s1, {_HALF} AS half, count(*) AS n, sum(g) AS g, sum(h) AS h FROM ({_DGH}) GROUP BY ALL), "
    "bh AS (SELECT half, f0, f1, s0 AS gate_state, greatest(sum(g * g / (h + 5)) - sum(g) * sum(g) / (sum(h) + 5), 0) / 2 AS gain FROM ch GROUP BY 1, 2, 3, 4 HAVING sum(n) >= greatest(10, ceil((SELECT count(*) FROM st) // 2 * 0.05)) AND sum(h) >= 1 AND count(*) > 1), "
    "w AS (SELECT f0, f1, gate_state, max(gain) FILTER (WHERE half = 0) AS a, max(gain) FILTER (WHERE half = 1) AS b FROM bh GROUP BY 1, 2, 3), "
    "s AS (SELECT 'stable' AS kind, w.f0, w.f1, w.gate_state, round(k.gain, 9) AS gain, round(2 * a * b / (a + b) * sqrt(least(a, b) / greatest(a, b)) / sqrt(64), 12) AS score FROM w JOIN k USING (f0, f1, gate_state) WHERE a > 0 AND b > 0), u AS (SELECT * FROM f UNION ALL SELECT * FROM s) "
    f"SELECT kind, f0, f1, gate_state, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY kind ORDER BY u.score DESC, gain DESC, list_position({_POS}, f0) DESC, gate_state DESC, list_position({_POS}, f1) DESC) AS INTEGER) AS rank FROM u QUALIFY rank <= 5"
)
def block_rank_shared(spark, sf_dir):
    """The best blocks on all rows and the best that hold in both halves, from one table of cells."""
    df = order_states(spark, sf_dir, 8).withColumn("half", F.pmod(scramble(F.col("o_orderkey")), F.lit(2)).cast("int"))
    n, p = df.agg(F.count("*"), F.avg("y")).first()
    cells = stats.tuple_cells(df, _DIRECTED, ["half"], sums={"g": F.col("y") - p, "h": F.lit(p * (1 - p))})
    full, stable, _ = rank.full_and_stable(cells, STATES, n, 8, 5)
    pick = lambda x, kind: x.select(F.lit(kind).alias("kind"), "f0", "f1", "gate_state", F.round("score", 6).alias("score"), "rank")
    return pick(full, "full").unionByName(pick(stable, "stable"))


@query(
    f"WITH {order_states_sql(8)}, {_GH}, {_CELLS}, l AS (SELECT unnest([1.0, 20.0]::DOUBLE[]) AS l2), a AS (SELECT l2, feature, sum(g * g / (h + l2)) / 2 AS gain FROM c1, l GROUP BY 1, 2), "
    "b AS (SELECT l2, f0, f1, sum(g * g / (h + l2)) / 2 AS gain FROM c2, l GROUP BY 1, 2, 3) SELECT b.l2, f0, f1, round(b.gain, 6) AS gain, round(b.gain - greatest(x.gain, z.gain), 6) AS excess FROM b JOIN a x ON x.l2 = b.l2 AND x.feature = f0 JOIN a z ON z.l2 = b.l2 AND z.feature = f1"
)
def newton_cache(spark, sf_dir):
    """Gains under two penalties from a cache of histograms that was stored and read again."""
    from .sources.programs import scratch_folder

    df = order_states(spark, sf_dir, 8)
    p = df.agg(F.avg("y")).first()[0]
    path = f"{scratch_folder(spark)}/cache-{uuid.uuid4().hex}"
    cache.HistogramCache.newton(df, STATES, "y", F.lit(p)).save(path)
    return rounded(cache.HistogramCache.load(spark, path).pair_gains([1.0, 20.0]))


@query(f"WITH {order_states_sql(4)}, xp AS ({LONG_PAIRS}) SELECT f0, f1, s0, s1, count(*) AS n, round(sum(price), 2) AS price, round(sum(xp.price * xp.y), 2) AS finished FROM xp GROUP BY 1, 2, 3, 4")
def value_cache(spark, sf_dir):
    """Sums of two targets in the cells of all pairs."""
    made = cache.HistogramCache.build(order_states(spark, sf_dir), STATES, {"price": F.col("price"), "finished": F.col("price") * F.col("y")})
    return rounded(made.pairs, 2)


@query(
    f"WITH {order_states_sql(16)}, l AS (SELECT s_price AS f, CAST(least(floor(s_price * 8 / 16), 7) AS INTEGER) AS m FROM st) SELECT 'f' AS fine, 'm' AS coarse, count(*) FILTER (WHERE f // 2 <> m) AS violations FROM l UNION ALL SELECT 'f', 'wrong', count(*) FILTER (WHERE f // 2 <> f // 4) FROM l"
)
def nested_violations(spark, sf_dir):
    """Rows whose fine state doesn't lie in their coarse state: of a true nesting and of a false one."""
    df = order_states(spark, sf_dir, 16).select(F.col("s_price").alias("f"), fn.coarser(F.col("s_price"), 16, 8).alias("m"), F.floor(F.col("s_price") / 4).alias("wrong"))
    return refine.nested_violations(df, [("f", "m", 2), ("f", "wrong", 2)])


@query(f"WITH {order_states_sql(4)} SELECT o_orderkey, CAST(s_price AS TINYINT) AS s_price, CAST(s_day AS SMALLINT) AS s_day FROM st")
def packed_states(spark, sf_dir):
    """States in the smallest types that hold 4 and 300 of them."""
    return adapt.packed_states(order_states(spark, sf_dir).select("o_orderkey", "s_price", "s_day"), {"s_price": 4, "s_day": 300})


_T3 = [(a, b, c) for i, a in enumerate(STATES) for j, b in enumerate(STATES[i + 1 :], i + 1) for c in STATES[j + 1 :]]
_T3_SQL = " UNION ALL ".join(f"SELECT '{a}' AS f0, '{b}' AS f1, '{c}' AS f2, {a} AS s0, {b} AS s1, {c} AS s2, g, h FROM gh" for a, b, c in _T3)


@query(
    f"WITH {order_states_sql(4)}, {_GH}, c AS (SELECT f0, f1, f2, s0, s1, s2, count(*) AS n, sum(g) AS g, sum(h) AS h FROM ({_T3_SQL}) GROUP BY ALL), "
    "t AS (SELECT f0, f1, f2, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE n >= 4) AS active, (sum(g * g / h) FILTER (WHERE n >= 4) - (sum(g) FILTER (WHERE n >= 4)) ** 2 / sum(h) FILTER (WHERE n >= 4)) / 2 AS bound FROM c GROUP BY ALL) "
    "SELECT f0, f1, f2, n, active, round(bound, 6) AS bound, active <= 37 OR 2 * bound < 10.83 AS rejected FROM t"
)
def triad_screen(spark, sf_dir):
    """Triples with a bound of what they can add to their pairs."""
    df = order_states(spark, sf_dir)
    p = df.agg(F.avg("y")).first()[0]
    return rounded(refine.triad_screen(stats.tuple_cells(df, _T3, sums={"g": F.col("y") - p, "h": F.lit(p * (1 - p))})))


@query(
    f"WITH {order_states_sql(8)}, {_GH}, x AS (SELECT feature, state, state // 2 AS parent, sum(g) AS g, sum(h) AS h FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{s}{chr(39)} AS feature, {s} AS state, g, h FROM gh' for s in STATES)}) GROUP BY ALL), "
    "f AS (SELECT feature, count(*) AS k, sum(g * g / h) AS fine FROM x GROUP BY 1), c AS (SELECT feature, count(*) AS k, sum(g * g / h) AS coarse FROM (SELECT feature, parent, sum(g) AS g, sum(h) AS h FROM x GROUP BY 1, 2) GROUP BY 1) "
    "SELECT f.feature, CAST(f.k - c.k AS INTEGER) AS df, round((fine - coarse) / 2, 6) AS gain FROM f JOIN c USING (feature)"
)
def resolution_gain(spark, sf_dir):
    """What eight states tell beyond four, for each feature."""
    df = order_states(spark, sf_dir, 8)
    p = df.agg(F.avg("y")).first()[0]
    found = refine.resolution_candidates(df, [(s, 8) for s in STATES], 4, F.lit(p) - F.col("y"), F.lit(p * (1 - p)), alpha=1.01, least_rows=1)
    return spark.createDataFrame([(b.columns[0], b.df, round(b.gain, 6)) for b in found], "feature string, df int, gain double")


@query(
    f"WITH {order_states_sql(16)} SELECT o_orderkey, CAST(s_price // 4 AS INTEGER) AS price_4, CAST(CASE WHEN s_price // 2 % 2 = 0 THEN 0 ELSE s_price // 4 + 1 END AS INTEGER) AS price_8, CAST(CASE WHEN s_price % 2 = 0 THEN 0 ELSE s_price // 2 + 1 END AS INTEGER) AS price_16, "
    "CAST((s_price // 4) * 4 + s_balance // 4 AS INTEGER) AS pair_4, CAST(CASE WHEN s_price // 2 % 2 = 0 AND s_balance // 2 % 2 = 0 THEN 0 ELSE (s_price // 4 * 4 + s_balance // 4) * 3 + (s_price // 2 % 2) * 2 + s_balance // 2 % 2 END AS INTEGER) AS pair_8 FROM st"
)
def nested_codes(spark, sf_dir):
    """Coarse states and the residual codes of finer levels, of a feature and of a pair."""
    df = order_states(spark, sf_dir, 16)
    codes = fn.nested_codes({"price": ("s_price", 16), "balance": ("s_balance", 16)}, [("price", "balance")])
    return df.select("o_orderkey", *[codes[c].alias(c) for c in ("price_4", "price_8", "price_16")], codes["price_x_balance_4"].alias("pair_4"), codes["price_x_balance_8"].alias("pair_8"))


@query(
    "WITH e AS (SELECT vec_id, embedding, label < 5 AS y, vec_id % 3 AS fold FROM embeddings), d AS (SELECT q.vec_id, e.vec_id AS other, e.y, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9) AS d2 FROM e q JOIN e ON q.fold <> e.fold WHERE q.vec_id % 20 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) AS k, 1 / (sqrt(d2) + 1e-9) AS w FROM d) SELECT vec_id, round(sum(w * CAST(y AS INTEGER)) FILTER (WHERE k <= 5) / sum(w) FILTER (WHERE k <= 5), 6) AS p5, round(sum(w * CAST(y AS INTEGER)) FILTER (WHERE k <= 15) / sum(w) FILTER (WHERE k <= 15), 6) AS p15 FROM r GROUP BY 1"
)
def knn_out_of_fold(spark, sf_dir):
    """Class shares among the 5 and 15 nearest embeddings of other folds."""
    df = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    out = adapt.knn_probability(df, "vec_id", "embedding", "y", F.col("vec_id") % 20 == 0, [5, 15], F.col("vec_id") % 3)
    return out.select("vec_id", F.round(F.col("probability")[0], 6).alias("p5"), F.round(F.col("probability")[1], 6).alias("p15"))


@query(
    "WITH p AS (SELECT label < 5 AS y, embedding AS c FROM embeddings QUALIFY row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) <= 3), d AS (SELECT vec_id, p.y, sqrt(min(list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))) AS d FROM embeddings, p GROUP BY 1, 2) "
    "SELECT vec_id, round(max(d) FILTER (WHERE NOT y) - max(d) FILTER (WHERE y), 6) AS score FROM d GROUP BY 1"
)
def prototype_score(spark, sf_dir):
    """How much nearer each embedding is to three prototypes of one class than to three of the other."""
    df = table(spark, sf_dir, "embeddings")
    first = lambda c: [r["embedding"] for r in df.where((F.col("label") < 5) == F.lit(bool(c))).orderBy("vec_id").limit(3).select("embedding").collect()]
    return df.select("vec_id", F.round(adapt.prototype_score("embedding", {c: np.array(first(c), float) for c in (0, 1)}), 6).alias("score"))


@query("WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) SELECT round(sum(v), 6) AS trace FROM (SELECT var_pop(x) AS v FROM x GROUP BY dim)")
def embedding_spectrum(spark, sf_dir):
    """The variance of embeddings along all of their principal directions."""
    _, directions, values = adapt.principal_directions(table(spark, sf_dir, "embeddings"), "embedding", 10_000)
    return spark.createDataFrame([(round(float(values.sum()), 6),)], "trace double")


_REPEATED = "r AS (SELECT l_extendedprice AS v, unnest(range(l_linenumber - 1)) FROM lineitem)"


@query(f"WITH {_REPEATED}, q AS (SELECT list_sort(list_distinct(list_filter(quantile_cont(v, [{', '.join(str(i / 8) for i in range(1, 8))}]), lambda t: t > min(v) AND t < max(v)))) AS t FROM r) SELECT CAST(unnest(range(1, len(t) + 1)) AS INTEGER) AS idx, round(unnest(t), 6) AS threshold FROM q")
def weighted_thresholds(spark, sf_dir):
    """Thresholds of prices where each line counts as often as its number says, less one."""
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_linenumber") - 1).alias("w"))
    cuts = quantiles.nested_thresholds(df, ["l_extendedprice"], (8,), weight="w")["l_extendedprice"][8]
    return spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(cuts)], "idx int, threshold double")


@query(
    f"WITH {order_states_sql(8)}, x AS (SELECT * FROM ({LONG}), range(3) t(i) WHERE i < o_orderkey % 4), m AS ({mi_sql('SELECT feature, state, y FROM x', 'feature', 'state', 'y')}) SELECT feature, round(mi, 8) AS mi FROM m"
)
def weighted_mi(spark, sf_dir):
    """Information of each feature where orders count 0 to 3 times."""
    df = order_states(spark, sf_dir, 8)
    cells = stats.state_cells(df, STATES, ["y"], weight=(F.col("o_orderkey") % 4).cast("double"))
    return rounded(stats.mutual_information(cells, ["feature"], ["state"], "y"), 8)


@query("SELECT 'score' AS what, 0.0 AS largest_error, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS n UNION ALL SELECT 'probability', 0.0, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey)")
def rewrite_error(spark, sf_dir):
    """The largest difference that rewriting the fixed program makes."""
    out = max_error(frozen_program(), optimised(frozen_program()), order_features(spark, sf_dir))
    return out.select("what", F.round("largest_error", 9).alias("largest_error"), "n")


_GATE = [0.125, -0.5, 0.75, 0.25, 0.0, -1.0]


@query(
    f"WITH {_STATES_SQL}, s AS (SELECT o_orderkey, 0.25 + CASE WHEN b = 1 THEN list_extract([{', '.join(map(str, _GATE))}], c + 1) ELSE 0 END + CASE WHEN a = 0 THEN b * b - 0.5 ELSE 0.5 * b END AS score FROM z) "
    "SELECT o_orderkey, round(score, 9) AS score, 2 AS tables FROM s"
)
def sparse_row_scores(spark, sf_dir):
    """Scores from tables of pairs that keep equal rows once: a block inside one gate state, and a row that differs from the rest."""
    inside = [[0.0] * 6, _GATE, [0.0] * 6]
    odd = [[b * b - 0.5 for b in range(3)], *[[0.5 * b for b in range(3)]] * 3]
    program = compacted(replace(frozen_program("identity"), unary=[], linear=[], pairs=[("num:balance", "catid:priority", inside), ("num:price", "num:balance", odd)]))
    return order_features(spark, sf_dir).select("o_orderkey", F.round(program.score(), 9).alias("score"), F.lit(len(program.sparse)).alias("tables"))


_DELTA = [("s_price", 2, 1, 0.5), ("s_day", 0, 2, -0.25)]


@query(
    f"WITH {order_states_sql(4)}, z AS (SELECT o_orderkey, 0.1 AS a, 0.2 + CASE WHEN s_price = 2 THEN 0.5 ELSE 0 END AS b, 0.3 + CASE WHEN s_day = 0 THEN -0.25 ELSE 0 END AS c FROM st) SELECT o_orderkey, round(exp(a) / (exp(a) + exp(b) + exp(c)), 9) AS p0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 9) AS p1 FROM z"
)
def class_delta_scores(spark, sf_dir):
    """Three class scores with a correction of two states."""
    from .operators.deltas import corrected

    scores = corrected(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)), [(F.col(c) == s, k, x) for c, s, k, x in _DELTA], 3)
    p = fn.softmax(scores)
    return order_states(spark, sf_dir).select("o_orderkey", F.round(p[0], 9).alias("p0"), F.round(p[1], 9).alias("p1"))



@query(ORACLES["ovr_softmax_scores"])
def shared_program_scores(spark, sf_dir):
    """Three classes from one program whose tables hold a row for all of them."""
    p = frozen_program("identity")
    bundle = Bundle([replace(q, linear=[]) for q in (p, p.calibrated(2.0, -1.0), Program({}))], "softmax", ["x", "y", "z"])
    month = (F.col("month") - 6.5) / 3.5 * 0.2  # the one term that tables can't hold
    z = F.zip_with(SharedProgram.of(bundle).scores(), F.array(month, 2 * month, F.lit(0.0)), lambda a, b: a + b)
    out = order_features(spark, sf_dir).withColumn("p", fn.softmax(z))
    classes = F.array(*map(F.lit, bundle.classes))
    return out.select("o_orderkey", *[F.round(F.col("p")[i], 9).alias(f"p{i}") for i in range(3)], F.element_at(classes, fn.argmax(F.col("p")) + 1).alias("prediction"))


# fitted models against what SQL can say of them: an (almost) unpenalised fit meets the sums of its target in every state
# that it has a coefficient for -----------------------------------------------------------------------------------------

FREE = {"bins": 4, "pair_features": 3, "max_pairs": 1}


def _margins(df, value, names: list[str]):
    """feature, state, n and mean of a fitted value, on the states of the four numeric columns."""
    entries = F.array(*[F.struct(F.lit(s).alias("feature"), F.col(s).alias("state")) for s in STATES])
    long = df.select(*[v.alias(n) for v, n in zip(value, names, strict=True)], F.explode(entries).alias("e"))
    return long.groupBy("e.feature", "e.state").agg(F.count("*").alias("n"), *[F.round(F.avg(n), 4).alias(n) for n in names])


@query(f"WITH {order_states_sql(4)} SELECT feature, state, count(*) AS n, round(avg(y), 4) AS p FROM ({LONG}) GROUP BY 1, 2")
def margins_classifier(spark, sf_dir):
    """A binary classifier's mean probability in each state of its main effects is the share of the class there."""
    from .models import StateClassifier

    df = order_states(spark, sf_dir)
    model = StateClassifier(**FREE, c=1e6).fit(df, NUMERIC, "y", "o_orderkey")
    return _margins(model.predict(df.select("o_orderkey", *NUMERIC, *STATES)), [F.col("probability")], ["p"])


@query(f"WITH {order_states_sql(4)} SELECT feature, state, count(*) AS n, {', '.join(f'round(avg(CAST(status = {chr(39)}{c}{chr(39)} AS INTEGER)), 4) AS p{i}' for i, c in enumerate(_STATUS))} FROM ({LONG}) GROUP BY 1, 2")
def margins_multiclass(spark, sf_dir):
    """A softmax regression's mean probabilities in each state are the shares of the classes there."""
    from .models import SharedClassifier

    df = order_states(spark, sf_dir)
    model = SharedClassifier(**(FREE | {"max_pairs": 0}), c=1e5).fit(df, NUMERIC, "status", "o_orderkey")
    out = model.predict(df.select("o_orderkey", *NUMERIC, *STATES))
    return _margins(out, [F.col("probabilities")[i] for i in range(3)], ["p0", "p1", "p2"])


@query(f"WITH {order_states_sql(4)} SELECT feature, state, count(*) AS n, round(avg(price), 4) AS p FROM ({LONG.replace('price, o_orderkey', 'price + 10 * balance AS price, o_orderkey')}) GROUP BY 1, 2")
def margins_ridge(spark, sf_dir):
    """A ridge regression's mean prediction in each state is the mean of the target there."""
    from .models import StateRidgeRegressor

    df = order_states(spark, sf_dir).withColumn("goal", F.col("price") + 10 * F.col("balance"))
    model = StateRidgeRegressor(**FREE, alpha=1e-7).fit(df, NUMERIC, "goal", "o_orderkey")
    return _margins(model.predict(df.select("o_orderkey", *NUMERIC, *STATES)), [F.col("prediction")], ["p"])


@query(f"WITH {order_states_sql(4)} SELECT feature, state, count(*) AS n, round(avg(price), 4) AS p, round(avg(bal), 4) AS q FROM ({LONG.replace('price, o_orderkey', 'price, balance AS bal, o_orderkey')}) GROUP BY 1, 2")
def margins_multioutput(spark, sf_dir):
    """Two targets on one design: both have their means in every state."""
    from .models import MultiOutputRegressor

    df = order_states(spark, sf_dir)
    model = MultiOutputRegressor(bins=4, alpha=1e-7, pair_features=3, max_pairs=1).fit(df, NUMERIC, ["price", "balance"], "o_orderkey")
    out = model.predict(df.select("o_orderkey", *NUMERIC, *STATES))
    return _margins(out, [F.col("prediction_price"), F.col("prediction_balance")], ["p", "q"])


@query("SELECT lang, count(*) AS n, round(avg(quality), 4) AS p, round(avg(toxic), 4) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def margins_multilabel(spark, sf_dir):
    """Two labels of documents: mean probabilities by language are the labels' shares there."""
    from .models import MultiLabelClassifier

    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    model = MultiLabelClassifier(**(FREE | {"max_pairs": 0}), max_features=8, c=1e5, threshold="none").fit(df, ["lang", "n_chars"], ["quality", "toxic"], "doc_id")
    out = model.predict(df.select("doc_id", "lang", "n_chars"))
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.col("probabilities")[0]), 4).alias("p"), F.round(F.avg(F.col("probabilities")[1]), 4).alias("q"))


@query("WITH e AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types FROM events GROUP BY 1) SELECT types, count(*) AS users, round(avg(n), 4) AS mean FROM e GROUP BY 1")
def margins_poisson(spark, sf_dir):
    """A Poisson regression's mean prediction for each number of event types is the mean number of events."""
    from .models import GeneralizedRegressor

    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.count_distinct("event_type").alias("types"))
    model = GeneralizedRegressor(loss="poisson", bins=8, alpha=1e-6, max_pairs=0).fit(df, ["mean_value", "types"], "n", "user_id")
    return model.predict(df.select("user_id", "mean_value", "types")).groupBy("types").agg(F.count("*").alias("users"), F.round(F.avg("prediction"), 4).alias("mean"))


@query(
    f"WITH {order_states_sql(4)}, q AS (SELECT s_month AS state, quantile_disc(price, 0.3) AS q FROM st GROUP BY 1) "
    "SELECT s_month AS state, count(*) AS n, round(avg(greatest(0.3 * (price - q), -0.7 * (price - q))), 2) AS loss FROM st JOIN q ON state = s_month GROUP BY 1"
)
def margins_quantile(spark, sf_dir):
    """The least pinball loss of a quantile of prices in each state of a column, from an unpenalised linear programme."""
    from .models import GeneralizedRegressor

    df = order_states(spark, sf_dir)
    model = GeneralizedRegressor(loss="quantile", quantiles=(0.3,), penalty="l1", alpha=0.0, bins=4, max_pairs=0).fit(df, ["month"], "price", "o_orderkey")
    out = model.predict(df.select("o_orderkey", "month", "price", "s_month"))
    return out.groupBy(F.col("s_month").alias("state")).agg(F.count("*").alias("n"), F.round(F.avg(stats.pinball(F.col("price"), F.col("prediction"), 0.3)), 2).alias("loss"))


_GATED = "CASE WHEN s_month = 3 THEN CAST(s_day >= 2 AS INTEGER) ELSE CAST((o_orderkey * 7919) % 1000003 % 2 AS INTEGER) END"


@query(f"WITH {order_states_sql(4)}, t AS (SELECT *, {_GATED} AS t FROM st) SELECT s_month AS gate, s_day AS state, count(*) AS n, round(avg(t), 4) AS p FROM t WHERE s_month = 3 GROUP BY 1, 2")
def margins_blocks(spark, sf_dir):
    """A target that a column tells only inside one state of another: the block is found and meets the shares inside."""
    from .models import BlockClassifier

    df = order_states(spark, sf_dir).withColumn("t", F.expr(_GATED.replace("INTEGER", "INT")))
    model = BlockClassifier(bins=4, max_pairs=0, pair_features=4, max_blocks=4, c=1e6, shrink=0.0).fit(df, NUMERIC, "t", "o_orderkey")
    chosen = model.diagnostics_[0]["blocks"]
    out = model.predict(df.select("o_orderkey", *NUMERIC, *STATES)).where("s_month = 3")
    found = out.where(F.lit(("num:month", 3, "num:day") in chosen))  # no rows without the block
    return found.groupBy(F.col("s_month").alias("gate"), F.col("s_day").alias("state")).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 4).alias("p"))


@query(
    f"WITH {order_states_sql(4)}, {_GH}, x AS ({' UNION ALL '.join(f'SELECT {chr(39)}{s}{chr(39)} AS feature, {s} AS state, g, h FROM gh' for s in STATES)}), c AS (SELECT feature, state, sum(g) AS g, sum(h) AS h FROM x GROUP BY 1, 2), o AS (SELECT feature, sum(g * g / (h + 5)) / 2 AS gain FROM c GROUP BY 1), "
    f"xp AS ({' UNION ALL '.join(f'SELECT {chr(39)}{a}{chr(39)} AS f0, {chr(39)}{b}{chr(39)} AS f1, {a} AS s0, {b} AS s1, g, h FROM gh' for a, b in PAIRS)}), d AS (SELECT f0, f1, s0, s1, sum(g) AS g, sum(h) AS h FROM xp GROUP BY ALL), p AS (SELECT f0, f1, sum(g * g / (h + 5)) / 2 AS gain FROM d GROUP BY 1, 2), "
    "e AS (SELECT p.gain - greatest(a.gain, b.gain) AS excess FROM p JOIN o a ON a.feature = f0 JOIN o b ON b.feature = f1), s AS (SELECT gain, row_number() OVER (ORDER BY gain DESC) AS i FROM o WHERE gain > 0), t AS (SELECT excess, row_number() OVER (ORDER BY excess DESC) AS i FROM e WHERE excess > 0), "
    "m AS (SELECT unnest([1, 2, 4]) AS max_features), k AS (SELECT unnest([0, 1, 3]) AS max_pairs) "
    "SELECT max_features, max_pairs, round((SELECT coalesce(sum(gain / sqrt(i)), 0) FROM s WHERE i <= max_features) + (SELECT coalesce(sum(excess / sqrt(i)), 0) FROM t WHERE i <= max_pairs), 6) AS promise FROM m, k"
)
def search_promises(spark, sf_dir):
    """What the histograms promise of nine candidate structures of a search."""
    from .models.search import discounted

    df = order_states(spark, sf_dir)
    share = df.agg(F.avg("y")).first()[0]
    singles, pairs = cache.HistogramCache.newton(df, STATES, "y", F.lit(share)).gains([5.0])
    one, two = list(singles[5.0].values()), list(pairs[5.0].values())
    return spark.createDataFrame([(m, k, round(discounted(one, m) + discounted(two, k), 6)) for m in (1, 2, 4) for k in (0, 1, 3)], "max_features int, max_pairs int, promise double")


@query(
    "WITH e AS (SELECT vec_id, label < 5 AS c, vec_id % 3 AS fold, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), s AS (SELECT dim, stddev_pop(x) AS s FROM e GROUP BY 1), "
    "m AS (SELECT f.fold, dim, avg(x) FILTER (WHERE NOT c) AS m0, avg(x) FILTER (WHERE c) AS m1 FROM e JOIN (SELECT DISTINCT fold FROM e) f ON e.fold <> f.fold GROUP BY 1, 2) "
    "SELECT vec_id, round(sum(((x - m0) / s) ** 2 - ((x - m1) / s) ** 2), 5) AS direction FROM e JOIN m USING (fold, dim) JOIN s USING (dim) GROUP BY 1"
)
def embedding_out_of_fold(spark, sf_dir):
    """How much nearer each embedding is to the second class's centroid than to the first's, both of other folds, by scaled components."""
    df = table(spark, sf_dir, "embeddings")
    fold = F.col("vec_id") % 3
    moments = adapt.Moments.of(df, "embedding", (F.col("label") < 5).cast("int"), fold, 3)
    each = [adapt.projected("embedding", m, d[None, :])[0] for m, d in (moments.centroid(k) for k in range(3))]
    return df.select("vec_id", F.round(F.coalesce(*[F.when(fold == k, x) for k, x in enumerate(each)]), 5).alias("direction"))


@query(
    "WITH RECURSIVE c AS (SELECT i, j, covar_pop(CAST(embedding[i] AS DOUBLE), CAST(embedding[j] AS DOUBLE)) AS x FROM embeddings, range(1, 1 + (SELECT max(len(embedding)) FROM embeddings)) a(i), range(1, 1 + (SELECT max(len(embedding)) FROM embeddings)) b(j) GROUP BY 1, 2), "
    "r AS (SELECT i, list(x ORDER BY j) AS row FROM c GROUP BY 1), p AS (SELECT 0 AS k, list(row ORDER BY i) AS m FROM r UNION ALL SELECT k + 1, list_transform(list_transform(m, lambda a: list_transform(m, lambda b: list_inner_product(a, b))), lambda a: list_transform(a, lambda x: x / list_inner_product(m[1], m[1]))) FROM p WHERE k < 14), "
    "v AS (SELECT list_transform(m, lambda a: a[1]) AS u FROM p WHERE k = 14), n AS (SELECT list_transform(u, lambda x: x / sqrt(list_inner_product(u, u))) AS u FROM v), s AS (SELECT list_transform(u, lambda x: x * CASE WHEN list_max(u) > -list_min(u) THEN 1 ELSE -1 END) AS u FROM n) "
    "SELECT CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS dim, round(unnest(u), 4) AS weight FROM s"
)
def principal_direction(spark, sf_dir):
    """The leading principal direction of the embeddings."""
    _, directions, _ = adapt.principal_directions(table(spark, sf_dir, "embeddings"), "embedding", 1)
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(directions[0])], "dim int, weight double")


@query(
    f"WITH {order_states_sql(8)}, {_GH}, x AS (SELECT feature, state, state // 2 AS parent, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{s}{chr(39)} AS feature, {s} AS state, g, h FROM gh' for s in STATES)}) GROUP BY ALL), u AS (SELECT * FROM x WHERE n >= 12), "
    "f AS (SELECT feature, count(*) AS k, sum(g * g / h) AS fine FROM u GROUP BY 1), c AS (SELECT feature, count(*) AS k, sum(g * g / h) AS coarse FROM (SELECT feature, parent, sum(g) AS g, sum(h) AS h FROM u GROUP BY 1, 2) GROUP BY 1), "
    "d AS (SELECT f.feature, f.k - c.k AS df, (fine - coarse) / 2 AS gain FROM f JOIN c USING (feature)) "
    "SELECT feature, CAST(df AS INTEGER) AS df, round(gain, 6) AS gain FROM d WHERE df = 4 AND exp(-gain) * (1 + gain) < 0.2 OR df = 2 AND exp(-gain) < 0.2"
)
def resolution_selected(spark, sf_dir):
    """Features whose eight states tell more beyond four than chance does in one of five cases."""
    df = order_states(spark, sf_dir, 8)
    p = df.agg(F.avg("y")).first()[0]
    found = refine.resolution_candidates(df, [(s, 8) for s in STATES], 4, F.lit(p) - F.col("y"), F.lit(p * (1 - p)), alpha=0.2)
    return spark.createDataFrame([(b.columns[0], b.df, round(b.gain, 6)) for b in found if b.df in (2, 4)], "feature string, df int, gain double")


@query()
def fit_blocks(spark, sf_dir):
    """A binary classifier of finished orders with conditional blocks: key, probability, class."""
    from .models import BlockClassifier

    df = kept_features(spark, sf_dir)
    columns = ["price", "balance", "day", "month", "segment"]
    model = BlockClassifier(bins=4, max_features=5, pair_features=4, max_pairs=1, max_blocks=4, c=0.5).fit(df, columns, "y", "o_orderkey")
    return model.predict(df.select("o_orderkey", *columns)).select("o_orderkey", "probability", "prediction")


@query()
def fit_refinement(spark, sf_dir):
    """A fixed program refined on finished orders: key and probability."""
    from .models import Refinement

    df = kept_features(spark, sf_dir)
    model = Refinement(["price", "balance"], triad_features=0).fit(df, frozen_program(), "y", "o_orderkey")
    return model.program_.transform(df).select("o_orderkey", F.col("prediction").alias("probability"))
