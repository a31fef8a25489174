"""Models with factors, chosen orders, and trees of every entity, over the monthly product series."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.functions import arima, regression
from demandloom.functions import seriesmath as sm
from demandloom.operators import entitytrees as trees
from demandloom.operators import selection as sel
from demandloom.operators import series as ops
from demandloom.operators import totals
from demandloom.plans import star
from demandloom.plans.choose import METRICS, RUN_FACTORS, metric_sql, twin
from demandloom.plans.forecast import _CANDIDATES, _DATE, _STEPS, _WIDE, HORIZON, START, history_with_factors, model_rows, product_series
from demandloom.plans.registry import job
from demandloom.plans.totals import FACTOR_COLUMNS, PRIORITIES
from demandloom.plans.twins import add_view, with_views
from demandloom.session import cut_lineage

# ---------------------------------------------------------------- factors in training


def usable_factors(spark, sf_dir) -> list[str]:
    """The asked factors whose column varies; the others teach a model nothing."""
    usable = ops.factor_columns(history_with_factors(spark, sf_dir).select(*_CANDIDATES), [])
    return [c for c in RUN_FACTORS if c in {r[0] for r in usable.where("usable").collect()}]


def series_with_factors(spark, sf_dir, future: bool = True):
    """One row per product with its series, the factor values of its periods and those of the coming ones.

    The coming values continue each factor at its own frequency and are the same for all products.
    """
    names = usable_factors(spark, sf_dir)
    known = star.factors(spark, sf_dir)
    rows = history_with_factors(spark, sf_dir)
    values = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in names])
    packed = rows.groupBy("product").agg(F.sort_array(F.collect_list(F.struct("period", "total_quantity", values.alias("x")))).alias("s"))
    out = packed.select(
        "product", F.col("s.period").alias("periods"), F.col("s.total_quantity").cast("array<double>").alias("ys"), F.size("s").alias("n"), F.col("s.x").alias("fx"),
    )
    if not future:
        return out
    asked = [PRIORITIES[FACTOR_COLUMNS.index(c)] for c in names]
    coming = ops.extend_factors(known.where(F.col("factor_name").isin(asked)), START, "2002-11-30")
    wide = totals.pivot_factors(coming, asked, names)
    table = wide.agg(F.transform(F.sort_array(F.collect_list(F.struct("factor_date", values.alias("x")))), lambda r: r["x"]).alias("t"))
    return out.withColumn("future", cut_lineage(table).scalar())


add_view(
    "dp_fx",
    f"""
SELECT i.product, i.t, coalesce(w.urgent, 0) AS f1, coalesce(w.high, 0) AS f2 FROM dp_idx i JOIN ({_WIDE}) w ON w.product = i.product AND w.period = i.period""",
    ["dp_idx", "dp_factors"],
)
add_view(
    "dp_coming",
    """
SELECT k, max(v) FILTER (factor_name = '1-URGENT') AS f1, max(v) FILTER (factor_name = '2-HIGH') AS f2 FROM (
  SELECT factor_name, k, greatest(regr_intercept(factor_value, t) + regr_slope(factor_value, t) * (count(*) + k), 0) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY factor_date) - 1 AS t FROM dp_factors), range(12) r(k) GROUP BY factor_name, k) GROUP BY k""",
    ["dp_factors"],
)
add_view(
    "dp_factor_fit",
    """
SELECT *, y0 - wa * a0 - wb * b0 - wc * c0 AS w0 FROM (
  SELECT *, (ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / det AS wa,
         (aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / det AS wb,
         (aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / det AS wc FROM (
    SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM (
      SELECT s.product, part, any_value(n) AS n, any_value(h) AS h, avg(y) AS y0, avg(s.t) AS a0, avg(f1) AS b0, avg(f2) AS c0,
             var_pop(s.t) AS aa, var_pop(f1) AS bb, var_pop(f2) AS cc, covar_pop(s.t, f1) AS ab, covar_pop(s.t, f2) AS ac, covar_pop(f1, f2) AS bc,
             covar_pop(y, s.t) AS ay, covar_pop(y, f1) AS yb, covar_pop(y, f2) AS cy
      FROM dp_sets s JOIN dp_fx x ON x.product = s.product AND x.t = s.t GROUP BY s.product, part)))""",
    ["dp_sets", "dp_fx"],
)
add_view(
    "dp_factor_line",
    """
SELECT f.product, part, f.k, greatest(w0 + wa * (n + f.k) + wb * coalesce(x.f1, c.f1) + wc * coalesce(x.f2, c.f2), 0) AS v
FROM (SELECT *, unnest(range(h)) AS k FROM dp_factor_fit) f
LEFT JOIN dp_fx x ON part = 'test' AND x.product = f.product AND x.t = n + f.k LEFT JOIN dp_coming c ON part = 'full' AND c.k = f.k""",
    ["dp_factor_fit", "dp_fx", "dp_coming"],
)
add_view(
    "dp_factor_score",
    metric_sql("product", "(SELECT f.product, i.y, f.v FROM dp_factor_line f JOIN dp_factor_fit g ON g.product = f.product AND g.part = 'test' "
               "JOIN dp_idx i ON i.product = f.product AND i.t = g.n + f.k WHERE f.part = 'test')"),
    ["dp_factor_line", "dp_factor_fit", "dp_idx"],
)


def factor_scored(spark, sf_dir, models):
    return sel.evaluate(series_with_factors(spark, sf_dir), ["product"], models, HORIZON, factors="fx", future="future")


@job("x1_factor_line", twin("dp_factor_score", then="SELECT * FROM dp_factor_score"))
def x1_factor_line(spark, sf_dir):
    """Scores of the line over time and two factors; the held-back months have their own factor values."""
    out = factor_scored(spark, sf_dir, ["linear_factors"])
    return out.select("product", F.col("test_periods").cast("bigint").alias("test_periods"), *METRICS)


@job("x1_factor_forecasts", twin("dp_factor_line", then="SELECT product, k AS step, round(v, 4) AS forecast FROM dp_factor_line WHERE part = 'full'"))
def x1_factor_forecasts(spark, sf_dir):
    """The same model ahead, over the continued factors."""
    out = factor_scored(spark, sf_dir, ["linear_factors"]).select("product", F.posexplode("forecast").alias("k", "v"))
    return out.select("product", F.col("k").cast("bigint").alias("step"), F.round("v", 4).alias("forecast"))


@job("x1_factor_models")
def x1_factor_models(spark, sf_dir):
    """Line and neighbours that learn from two factors."""
    out = factor_scored(spark, sf_dir, ["linear_factors", "knn"])
    return out.select("product", "algorithm", *METRICS, F.size("forecast").alias("forecast_steps"))


@job(
    "x3_factor_fit",
    twin(
        "dp_score", "dp_factor_score",
        then="""
, s AS (SELECT product, algorithm, mape FROM dp_score WHERE algorithm = 'linear_regression' UNION ALL SELECT product, 'linear_factors', mape FROM dp_factor_score),
r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY mape, algorithm) AS rn, avg(mape) OVER (PARTITION BY product) AS blend FROM s)
SELECT product, CASE WHEN blend < mape THEN 'ensemble' ELSE algorithm END AS selected_algorithm, least(blend, mape) AS mape FROM r WHERE rn = 1""",
    ),
)
def x3_factor_fit(spark, sf_dir):
    """Whether factors help: the better of the line with and without them."""
    out = sel.best_fit(factor_scored(spark, sf_dir, ["linear_regression", "linear_factors"]), ["product"], "mape")
    return out.select("product", "selected_algorithm", "mape")


# ---------------------------------------------------------------- consensus trend

_DRAW = "((((44 * 48271 % 2147483647) + k + 1) * 48271 % 2147483647 + i + 1) * 48271 % 2147483647) * 48271 % 2147483647"


@job(
    "m2_consensus_trend",
    with_views(
        "dp_idx",
        then=f"""
, p AS (SELECT product, CAST(t - greatest(n - 30, 0) AS BIGINT) AS i, y, least(n, 30) AS m FROM dp_idx WHERE t >= n - 30),
room AS (SELECT product, stddev_pop(y) * 0.5 AS room FROM dp_idx WHERE t >= n - 12 GROUP BY product),
d AS (SELECT *, row_number() OVER (PARTITION BY product, k ORDER BY {_DRAW}, i) AS rn FROM p, range(40) r(k)),
f AS (SELECT product, k, regr_slope(y, i) AS s, regr_intercept(y, i) AS b FROM d WHERE rn <= greatest(3, m // 2) GROUP BY product, k),
a AS (SELECT f.product, k, i, y, count(*) OVER (PARTITION BY f.product, k) AS c FROM f JOIN p ON p.product = f.product
      JOIN room ON room.product = f.product WHERE abs(y - b - s * i) <= room),
w AS (SELECT *, dense_rank() OVER (PARTITION BY product ORDER BY c DESC, k) AS rk FROM a)
SELECT product, round(regr_slope(y, i), 6) AS slope FROM w WHERE rk = 1 GROUP BY product""",
    ),
)
def m2_consensus(spark, sf_dir):
    """Slope of the last 30 months that most points agree on."""
    return product_series(spark, sf_dir).select("product", F.round(regression.consensus_slope(sm.tail(F.col("ys"), 30)), 6).alias("slope"))


@job("m2_consensus_polynomial")
def m2_consensus_polynomial(spark, sf_dir):
    return model_rows(spark, sf_dir, sel.MODELS["consensus_polynomial"])


# ---------------------------------------------------------------- autoregression with order


@job(
    "m13_arima",
    with_views(
        "dp_idx", recursive=True,
        then=f"""
, l AS (SELECT *, lag(d) OVER o AS d1, lag(d, 2) OVER o AS d2 FROM (
        SELECT product, t - 1 AS j, y, n, y - lag(y) OVER (PARTITION BY product ORDER BY t) AS d FROM dp_idx) WHERE j >= 0 WINDOW o AS (PARTITION BY product ORDER BY j)),
g AS (SELECT product, (sy * tt - ty * st) / (ss * tt - st * st) AS a1, (ty * ss - sy * st) / (ss * tt - st * st) AS a2, my, ms, mt FROM (
  SELECT product, avg(d) AS my, avg(d1) AS ms, avg(d2) AS mt, var_pop(d1) AS ss, var_pop(d2) AS tt, covar_pop(d1, d2) AS st, covar_pop(d, d1) AS sy, covar_pop(d, d2) AS ty
  FROM l WHERE j >= 2 GROUP BY product)),
e AS (SELECT l.*, CASE WHEN j < 2 THEN 0 ELSE d - my - a1 * (d1 - ms) - a2 * (d2 - mt) END AS e FROM l JOIN g ON g.product = l.product),
x AS (SELECT *, lag(e) OVER (PARTITION BY product ORDER BY j) AS e1 FROM e),
f AS (SELECT product, phi, theta, my - phi * ms - theta * mt AS c FROM (
  SELECT product, (sy * tt - ty * st) / (ss * tt - st * st) AS phi, (ty * ss - sy * st) / (ss * tt - st * st) AS theta, my, ms, mt FROM (
    SELECT product, avg(d) AS my, avg(d1) AS ms, avg(e1) AS mt, var_pop(d1) AS ss, var_pop(e1) AS tt, covar_pop(d1, e1) AS st, covar_pop(d, d1) AS sy, covar_pop(d, e1) AS ty
    FROM x WHERE j >= 3 GROUP BY product))),
r AS (SELECT l.product, c, phi, theta, j, d, CAST(0 AS DOUBLE) AS e, y FROM l JOIN f ON f.product = l.product WHERE j = 0
  UNION ALL SELECT r.product, c, phi, theta, l.j, l.d, l.d - c - phi * r.d - theta * r.e, l.y FROM r JOIN l ON l.product = r.product AND l.j = r.j + 1),
ends AS (SELECT r.* FROM r JOIN (SELECT product, max(j) AS j FROM l GROUP BY product) m ON m.product = r.product AND m.j = r.j),
roll AS (SELECT product, c, phi, 0 AS k, c + phi * d + theta * e AS d, y + c + phi * d + theta * e AS v FROM ends WHERE abs(phi) < 1 AND abs(theta) < 1
  UNION ALL SELECT product, c, phi, k + 1, c + phi * d, v + c + phi * d FROM roll WHERE k < {HORIZON - 1}),
line AS (SELECT product, regr_slope(y, t) AS s, regr_intercept(y, t) AS b, count(*) AS n FROM dp_idx GROUP BY product)
SELECT product, CAST(k AS BIGINT) AS step, {_DATE}, round(greatest(v, 0), 4) AS forecast FROM roll
UNION ALL SELECT product, k, {_DATE}, round(greatest(b + s * (n + k), 0), 4) FROM line, {_STEPS} WHERE product IN (SELECT product FROM ends WHERE NOT (abs(phi) < 1 AND abs(theta) < 1))""",
    ),
)
def m13_arima(spark, sf_dir):
    """Order (1, 1, 1): one lag and one innovation of the first differences."""
    return model_rows(spark, sf_dir, arima.arima)


def order_grid(series):
    return ops.parameter_grid(series, {"p_list": [0, 1, 2], "d_list": [0, 1, 2], "q_list": [0, 1, 2]})


@job("m13_orders")
def m13_orders(spark, sf_dir):
    """All orders up to two as rows of one plan, with the innovations' sum of squares."""
    grid = order_grid(product_series(spark, sf_dir))
    fitted = grid.withColumn("f", arima.fit(arima.differenced(F.col("ys"), F.col("d")), F.col("p"), F.col("q")))
    return fitted.select("product", "p", "d", "q", F.round("f.css", 4).alias("css"), F.col("f.m").alias("values_scored"))


@job("m14_chosen_order")
def m14_chosen(spark, sf_dir):
    """The order that the information criterion chooses for each product, after its seasonal and level differences."""
    return product_series(spark, sf_dir).select("product", arima.chosen_order(F.col("ys")).alias("o")).select("product", "o.*")


@job("m14_auto")
def m14_auto(spark, sf_dir):
    return model_rows(spark, sf_dir, arima.auto_sarima)


# ---------------------------------------------------------------- trees of every entity

STUMPS = 5


@job(
    "m11_entity_stumps",
    with_views(
        "dp_idx", recursive=True,
        then=f"""
, rows_ AS (SELECT product, t - 5 AS r, y, n - 5 AS m, [x5, x4, x3, x2, x1, CAST(t AS DOUBLE)] AS x FROM (
    SELECT *, {", ".join(f"lag(y, {i}) OVER w AS x{i}" for i in range(1, 6))} FROM dp_idx WINDOW w AS (PARTITION BY product ORDER BY t)) WHERE t >= 5),
picks AS (SELECT product, k, {_DRAW} % m AS r, count(*) AS w FROM (SELECT product, any_value(m) AS m, unnest(range(any_value(m))) AS i FROM rows_ GROUP BY product), range({STUMPS}) a(k) GROUP BY ALL),
cells AS (SELECT p.product, k, f, x[f + 1] AS v, sum(w * y) AS g, sum(w) AS h FROM rows_ s JOIN picks p ON p.product = s.product AND p.r = s.r, range(6) b(f) GROUP BY ALL),
sums AS (SELECT product, k, f, (v + lead(v) OVER o) / 2 AS thr, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER z AS ga, sum(h) OVER z AS ha FROM cells
  WINDOW o AS (PARTITION BY product, k, f ORDER BY v), z AS (PARTITION BY product, k, f)),
best AS (SELECT *, row_number() OVER (PARTITION BY product, k ORDER BY gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) DESC, f, thr) AS rn FROM sums WHERE thr IS NOT NULL),
trees AS (SELECT product, list({{'f': f, 'thr': thr, 'lo': gl / hl, 'hi': (ga - gl) / (ha - hl)}}) AS ts FROM best WHERE rn = 1 GROUP BY product),
seed AS (SELECT i.product, list(y ORDER BY t) FILTER (t >= n - 5) AS win, any_value(n) AS n FROM dp_idx i GROUP BY i.product),
roll AS (SELECT s.product, n, ts, 0 AS k, win, list_avg(list_transform(ts, lambda q: CASE WHEN list_append(win, CAST(n AS DOUBLE))[q.f + 1] > q.thr THEN q.hi ELSE q.lo END)) AS v
         FROM seed s JOIN trees t ON t.product = s.product
  UNION ALL SELECT product, n, ts, k + 1, list_append(win[2:], v),
         list_avg(list_transform(ts, lambda q: CASE WHEN list_append(list_append(win[2:], v), CAST(n + k + 1 AS DOUBLE))[q.f + 1] > q.thr THEN q.hi ELSE q.lo END)) FROM roll WHERE k < {HORIZON - 1})
SELECT product, CAST(k AS BIGINT) AS step, round(greatest(v, 0), 4) AS forecast FROM roll""",
    ),
)
def m11_stumps(spark, sf_dir):
    """Forests of single cuts, one forest for every product."""
    series = cut_lineage(product_series(spark, sf_dir))
    return _steps(trees.forest_forecast(series, ["product"], HORIZON, n_estimators=STUMPS, max_depth=1))


def _steps(made):
    return made.select("product", F.posexplode("forecast").alias("k", "v")).select("product", F.col("k").cast("bigint").alias("step"), F.round("v", 4).alias("forecast"))


@job("m11_entity_forest")
def m11_entity(spark, sf_dir):
    """A forest of twenty trees, four levels deep, for every product."""
    series = cut_lineage(product_series(spark, sf_dir))
    return _steps(trees.forest_forecast(series, ["product"], HORIZON, n_estimators=20, max_depth=4))


@job("m12_entity_boosting")
def m12_entity(spark, sf_dir):
    """Boosted trees for every product."""
    series = cut_lineage(product_series(spark, sf_dir))
    return _steps(trees.boosting_forecast(series, ["product"], HORIZON, n_estimators=5, max_depth=2, learning_rate=0.3))


TREES = {
    "random_forest": lambda runs, keys: trees.forest_forecast(cut_lineage(runs), keys, F.col("h"), n_estimators=10, max_depth=3),
    "gradient_boosting": lambda runs, keys: trees.boosting_forecast(cut_lineage(runs), keys, F.col("h"), n_estimators=3, max_depth=2, learning_rate=0.5),
}


@job("x3_tree_fit")
def x3_trees(spark, sf_dir):
    """Best of expression models and of trees fitted for every product on the same split."""
    series = cut_lineage(product_series(spark, sf_dir))
    plain = sel.evaluate(series, ["product"], ["linear_regression", "seasonal_decomposition", "arima_order"], HORIZON)
    both = plain.unionByName(sel.evaluate_fitted(series, ["product"], TREES, HORIZON))
    return sel.best_fit(both, ["product"], "mape").select("product", "selected_algorithm", "candidates", "mape", F.size("forecast").alias("steps"))


# ---------------------------------------------------------------- the grid as data

GRID = {"alpha_list": [0.1, 0.3, 0.5], "window_list": [3, 4, 6], "k_list": [3, 5]}


@job(
    "x2_model_grid",
    twin(
        "dp_sets", "dp_idx",
        then=f"""
, pars(algorithm, alpha, w) AS (VALUES ('simple_exponential_smoothing', CAST(0.1 AS DOUBLE), NULL), ('simple_exponential_smoothing', 0.3, NULL), ('simple_exponential_smoothing', 0.5, NULL),
  ('moving_average', NULL, 3), ('moving_average', NULL, 4), ('moving_average', NULL, 6)),
s AS (SELECT product, alpha, t, n AS cut, y AS level FROM dp_sets, pars WHERE part = 'test' AND t = 0 AND alpha IS NOT NULL
  UNION ALL SELECT d.product, alpha, d.t, cut, alpha * d.y + (1 - alpha) * level FROM s JOIN dp_sets d ON d.product = s.product AND d.part = 'test' AND d.t = s.t + 1),
ma AS (SELECT product, w, n AS cut, CAST(0 AS BIGINT) AS k, greatest(least(greatest(list_avg(win) + sl, lo), hi), 0) AS v, win, sl, lo, hi, h FROM (
    SELECT product, w, any_value(n) AS n, list(y ORDER BY t) FILTER (t >= n - w) AS win, regr_slope(y, t) FILTER (t >= n - least(2 * w, 12)) AS sl, any_value(h) AS h,
           greatest(min(y) * 0.5, 0) AS lo, max(y) * 1.5 AS hi FROM dp_sets, pars WHERE part = 'test' AND w IS NOT NULL GROUP BY product, w)
  UNION ALL SELECT product, w, cut, k + 1, greatest(least(greatest(list_avg(list_append(win[2:], v)) + sl * power(0.95, k + 1), lo), hi), 0), list_append(win[2:], v), sl, lo, hi, h FROM ma WHERE k + 1 < h),
pr AS (SELECT s.product, 'simple_exponential_smoothing' AS algorithm, alpha, CAST(NULL AS INTEGER) AS w, i.y, level AS v FROM s JOIN dp_idx i ON i.product = s.product WHERE s.t = cut - 1 AND i.t >= cut
  UNION ALL SELECT ma.product, 'moving_average', NULL, w, i.y, ma.v FROM ma JOIN dp_idx i ON i.product = ma.product AND i.t = cut + k),
sc AS ({metric_sql("product, algorithm, alpha, w", "pr")})
SELECT product, algorithm, alpha, w AS "window", mape, accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY product, algorithm ORDER BY accuracy DESC, alpha, w) AS rn FROM sc) WHERE rn = 1""",
    ),
)
def x2_grid(spark, sf_dir):
    """The best parameters of each model and product, from one plan over product, model and parameter set."""
    out = sel.evaluate_grid(product_series(spark, sf_dir), ["product"], {"simple_exponential_smoothing": {"alpha_list": GRID["alpha_list"]}, "moving_average": {"window_list": GRID["window_list"]}}, HORIZON)
    best = sel.best_parameters(out, ["product", "algorithm"], ["alpha", "window"])
    return best.select("product", "algorithm", "alpha", "window", "mape", "accuracy")


@job("x2_neighbour_grid")
def x2_neighbours(spark, sf_dir):
    """The same with neighbours and orders, each with lists of its own."""
    grids = {"knn": {"k_list": GRID["k_list"]}, "arima_order": {"p_list": [0, 1], "q_list": [0, 1]}, "linear_regression": {}}
    out = sel.evaluate_grid(product_series(spark, sf_dir), ["product"], grids, HORIZON)
    return sel.best_parameters(out, ["product", "algorithm"], ["k", "p", "q"]).select("product", "algorithm", "k", "p", "q", "mape", "accuracy")
