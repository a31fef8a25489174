"""Entity trees, ordered autoregression, factors and the consensus trend against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.functions import arima, regression
from demandloom.functions import seriesmath as sm
from demandloom.operators import entitytrees as trees
from demandloom.operators import selection as sel
from demandloom.operators import series as ops

LAGS = 5


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for i in range(8):
        t = np.arange(26 + 4 * i)
        y = 60 + i * t * 0.7 + (25 if i % 2 else 3) * np.sin(t * 2 * np.pi / 12) + rng.integers(0, 20, len(t)).cumsum() * (i % 3) * 0.3
        out.append((f"p{i}", [float(round(v)) for v in y]))
    return [*out, ("ties", [5.0, 7.0] * 9), ("flat", [4.0] * 15), ("short", [3.0, 5.0, 7.0, 9.0])]


@pytest.fixture(scope="module")
def series(spark, rows):
    df = spark.createDataFrame(rows, "product string, ys array<double>")
    days = F.transform("ys", lambda _, i: F.add_months(F.lit("2000-01-01").cast("date"), i))
    return df.withColumn("periods", days)


def draw(*parts):
    out = 1
    for p in parts:
        out = (out + p + 1) * 48271 % 2147483647
    return out * 48271 % 2147483647


def lag_rows(y):
    return np.array([[*y[i - LAGS : i], i] for i in range(LAGS, len(y))], float), np.array(y[LAGS:])


def grow(x, g, h, depth, least, ridge):
    """One tree as nested tuples (feature, threshold, low, high) or a value; targets are whole millionths."""
    best = None
    for f in range(x.shape[1] if depth else 0):
        values = np.unique(x[h > 0, f])
        for a, b in zip(values[:-1], values[1:], strict=True):
            t = (a + b) / 2
            low = x[:, f] <= t
            gl, hl, ga, ha = float(g[low].sum()), float(h[low].sum()), float(g.sum()), float(h.sum())
            if hl >= least and ha - hl >= least:
                gain = gl * gl / (hl + ridge) + (ga - gl) * (ga - gl) / (ha - hl + ridge) - ga * ga / (ha + ridge)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, t, low
    if best is None:
        return float(g.sum()) / (float(h.sum()) + ridge) / 1e6
    _, f, t, low = best
    return f, t, grow(x[low], g[low], h[low], depth - 1, least, ridge), grow(x[~low], g[~low], h[~low], depth - 1, least, ridge)


def value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[3] if x[tree[0]] > tree[1] else tree[2]
    return tree


def rolled(y, h, predict):
    win, out = list(y[-LAGS:]), []
    for k in range(h):
        out.append(max(predict([*win, len(y) + k]), 0.0))
        win = [*win[1:], out[-1]]
    return out


def line(y, h):
    s, b = np.polyfit(np.arange(len(y)), y, 1)
    return [max(b + s * (len(y) + k), 0.0) for k in range(h)]


def forest(y, h, n, depth, least):
    x, target = lag_rows(y)
    weights = [np.bincount([draw(42, t, j) % len(x) for j in range(len(x))], minlength=len(x)) for t in range(n)]
    made = [grow(x[w > 0], np.rint(target * 1e6).astype(np.int64)[w > 0] * w[w > 0], w[w > 0], depth, least, 0.0) for w in weights]
    return rolled(y, h, lambda q: sum(value(t, q) for t in made) / n)


def boosting(y, h, n, depth, rate):
    x, target = lag_rows(y)
    base = round(float(np.mean(target)) * 1e6)
    left, made = np.rint(target * 1e6).astype(np.int64) - base, []
    scaled = lambda t: (*t[:2], scaled(t[2]), scaled(t[3])) if isinstance(t, tuple) else t * rate
    for _ in range(n):
        made.append(scaled(grow(x, left, np.ones(len(x), np.int64), depth, 1, 1.0)))
        left = left - np.array([math.floor(abs(v) * 1e6 + 0.5) * (1 if v >= 0 else -1) for v in (value(made[-1], r) for r in x)])
    return rolled(y, h, lambda q: base / 1e6 + sum(value(t, q) for t in made))


def test_forest_per_entity(series, rows):
    got = {r[0]: r[1] for r in trees.forest_forecast(series, ["product"], 4, n_estimators=4, max_depth=3, min_samples_leaf=2).collect()}
    for name, y in rows:
        assert got[name] == pytest.approx(line(y, 4) if len(y) < 10 else forest(y, 4, 4, 3, 2), rel=1e-9), name


def test_boosting_per_entity(series, rows):
    got = {r[0]: r[1] for r in trees.boosting_forecast(series, ["product"], 3, n_estimators=5, max_depth=2, learning_rate=0.3).collect()}
    for name, y in rows:
        assert got[name] == pytest.approx(line(y, 3) if len(y) < 10 else boosting(y, 3, 5, 2, 0.3), rel=1e-7), name


def test_trees_refuse_settings(series):
    for bad in ({"n_estimators": 0}, {"max_depth": 51}, {"min_samples_leaf": 11}):
        with pytest.raises(ValueError):
            trees.fit_forest(series, ["product"], **bad)


def test_trees_are_scored_like_expressions(series, rows):
    model = {"forest": lambda runs, keys: trees.forest_forecast(runs, keys, F.col("h"), n_estimators=3, max_depth=2)}
    out = {r["product"]: r for r in sel.evaluate_fitted(series, ["product"], model, 2).collect()}
    plain = {r["product"]: r for r in sel.evaluate(series, ["product"], ["linear_regression"], 2).collect()}
    for name, y in rows:
        cut = len(plain[name]["test_actual"]) if plain[name]["test_actual"] else 0
        assert out[name]["test_actual"] == plain[name]["test_actual"] and out[name]["test_dates"] == plain[name]["test_dates"]
        if len(y) - cut >= 10:
            assert out[name]["test_forecast"] == pytest.approx(forest(y[: len(y) - cut], cut, 3, 2, 1), rel=1e-9)
            assert out[name]["forecast"] == pytest.approx(forest(y, 2, 3, 2, 1), rel=1e-9)


# ---------------------------------------------------------------- autoregression


def regress(x, y):
    """Intercept and weights; constant and dependent columns share weight by a ridge on correlations."""
    x, y = np.array(x, float), np.array(y, float)
    if not x.shape[1]:
        return y.mean(), np.zeros(0)
    m, s = x.mean(0), x.std(0)
    s = np.where(s > 0, s, 1)
    z = (x - m) / s
    a, b = z.T @ z / len(y), z.T @ (y - y.mean()) / len(y)
    if np.linalg.matrix_rank(a, 1e-9) < len(a):
        a = a + 1e-6 * np.eye(len(a))
    w = np.linalg.solve(a, b) / s
    return y.mean() - w @ m, w


def stable(w):
    a, b = ([0.0, 0.0, *w][-1], [0.0, 0.0, *w][-2])
    return abs(b) < 1 and a + b < 1 and b - a < 1


def arma(w, p, q, burn=None):
    n, long, burn = len(w), max(p, q) + 1, max(p, q) if burn is None else burn
    if n < 3 * (p + q) + 6:
        return None
    e = np.zeros(n)
    if q:
        c, a = regress([w[t - long : t] for t in range(long, n)], w[long:])
        e[long:] = [w[t] - c - a @ w[t - long : t] for t in range(long, n)]
    begin = long + q if q else p
    c, a = regress([[*w[t - p : t], *e[t - q : t]] for t in range(begin, n)], w[begin:]) if p + q else (w.mean(), np.zeros(0))
    phi, theta = a[:p], a[p:]
    if not (stable(phi) and stable(-theta)):
        return None
    es, css, m = [0.0] * q, 0.0, 0
    for t in range(max(p, q), n):
        x = w[t] - c - phi @ w[t - p : t] - theta @ np.array(es)
        es = [*es, x][1:] if q else []
        css, m = css + (x * x if t >= burn else 0), m + (t >= burn)
    return c, phi, theta, css, m, es


def arima_path(y, h, p, d, q):
    y = np.array(y)
    w = np.diff(y, d)
    f = arma(w, p, q)
    if f is None:
        return line(y, h)
    c, phi, theta, _, _, es = f
    win, out = list(w[len(w) - p :]), []
    for _ in range(h):
        v = c + phi @ np.array(win) + theta @ np.array(es)
        win, es = ([*win, v][1:] if p else []), ([*es, 0.0][1:] if q else [])
        out.append(v)
    out = np.array(out)
    for k in range(d):
        out = np.cumsum(out) + np.diff(y, d - 1 - k)[-1]
    return np.maximum(out, 0)


def test_arima_orders_are_columns(series, rows):
    grid = ops.parameter_grid(series, {"p_list": [0, 1, 2], "d_list": [0, 1, 2], "q_list": [0, 1, 2]})
    made = grid.select("product", "p", "d", "q", arima.arima(F.col("ys"), 4, F.col("p"), F.col("d"), F.col("q")).alias("f"))
    ys = dict(rows)
    for r in made.where("product NOT IN ('ties', 'flat')").collect():
        assert r["f"] == pytest.approx(arima_path(ys[r["product"]], 4, r["p"], r["d"], r["q"]), rel=1e-6, abs=1e-6), r


def kpss(y):
    x = y - y.mean()
    n, lags = len(x), int(4 * (len(x) / 100) ** 0.25)
    spread = x @ x + 2 * sum((1 - k / (lags + 1)) * (x[k:] @ x[:-k]) for k in range(1, lags + 1))
    return (np.cumsum(x) ** 2).sum() / (n * spread) if spread else 0.0


def strength(y):
    pad = np.concatenate([np.zeros(6), y, np.zeros(5)])
    rest = y - np.array([pad[i : i + 12].sum() for i in range(len(y))]) / 12
    left = rest - np.array([rest[i % 12 :: 12].mean() for i in range(len(y))])
    return max(1 - left.var() / rest.var(), 0) if rest.var() else 0.0


def test_chosen_order_is_the_best_of_all(series, rows):
    got = {r["product"]: r["o"] for r in series.where("product LIKE 'p%'").select("product", arima.chosen_order(F.col("ys")).alias("o")).collect()}
    kinds = set()
    for name, y in rows:
        if not name.startswith("p"):
            continue
        y = np.array(y)
        seasonal = len(y) >= 24 and strength(y) > 0.64
        u = y[12:] - y[:-12] if seasonal else y
        d = 0 if kpss(u) <= 0.463 else 1 if kpss(np.diff(u)) <= 0.463 else 2
        w, scores = np.diff(u, d), []
        for p in range(3):
            for q in range(3):
                f = arma(w, p, q, 2)
                if f is not None:
                    k, m = p + q + 2, f[4]
                    scores.append((round(m * math.log(f[3] / m) + 2 * k + 2 * k * (k + 1) / max(m - k - 1, 1), 6), p, q))
        assert (got[name]["seasonal"], got[name]["d"]) == (seasonal, d), name
        if scores:
            assert (got[name]["p"], got[name]["q"]) == min(scores)[1:], name
            assert got[name]["aicc"] == pytest.approx(min(scores)[0], rel=1e-6)
        kinds.add((seasonal, d))
    assert len(kinds) > 1


def test_auto_sarima_gives_finite_steps(series, rows):
    for r in series.select("product", arima.auto_sarima(F.col("ys"), 5).alias("f")).collect():
        assert len(r["f"]) == 5 and all(v is not None and math.isfinite(v) and v >= 0 for v in r["f"]), r


# ---------------------------------------------------------------- least squares, factors, consensus


def test_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4)) * [1, 50, 0.01, 1000]
    y = x @ [2, -0.5, 300, 0.001] + 7 + rng.normal(size=30)
    double = np.c_[x[:, :2], x[:, 0] * 3, np.ones(30)]  # a dependent and a constant column
    df = spark.createDataFrame([("plain", x.tolist(), y.tolist()), ("dependent", double.tolist(), y.tolist())], "name string, x array<array<double>>, y array<double>")
    got = {r["name"]: r["f"] for r in df.select("name", regression.least_squares(F.col("x"), F.col("y")).alias("f")).collect()}
    want = np.linalg.lstsq(np.c_[np.ones(30), x], y, rcond=None)[0]
    assert [got["plain"]["intercept"], *got["plain"]["weights"]] == pytest.approx(want, rel=1e-6)
    fitted = double @ np.array(got["dependent"]["weights"]) + got["dependent"]["intercept"]
    best = np.c_[np.ones(30), double] @ np.linalg.lstsq(np.c_[np.ones(30), double], y, rcond=None)[0]
    assert fitted == pytest.approx(best, rel=1e-3, abs=1e-2)


def test_models_learn_factors(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=(48, 2))
    y = 100 + 0.5 * np.arange(40) + f[:40] @ [30, -20]
    df = spark.createDataFrame([("a", y.tolist(), f[:40].tolist(), f[40:].tolist())], "product string, ys array<double>, fx array<array<double>>, future array<array<double>>")
    df = df.withColumn("periods", F.transform("ys", lambda _, i: F.add_months(F.lit("2000-01-01").cast("date"), i)))
    out = {r["algorithm"]: r for r in sel.evaluate(df, ["product"], ["linear_regression", "linear_factors", "knn"], 8, factors="fx", future="future").collect()}
    assert out["linear_factors"]["forecast"] == pytest.approx(100 + 0.5 * np.arange(40, 48) + f[40:] @ [30, -20], rel=1e-6)
    assert out["linear_factors"]["mape"] < 0.01 < out["linear_regression"]["mape"]

    def neighbours(y, fx, ahead):
        x = np.array([[*y[i - 5 : i], i, *fx[i]] for i in range(5, len(y))])
        m, s = x.mean(0), x.std(0)
        win, made = list(y[-5:]), []
        for k, g in enumerate(ahead):
            q = (np.array([*win, len(y) + k, *g]) - m) / s
            near = np.argsort(((((x - m) / s) - q) ** 2).sum(1), kind="stable")[:5]
            made.append(max(np.mean([y[5 + i] for i in near]), 0))
            win = [*win[1:], made[-1]]
        return made

    assert out["knn"]["forecast"] == pytest.approx(neighbours(y, f[:40], f[40:]), rel=1e-9)
    assert out["knn"]["test_forecast"] == pytest.approx(neighbours(y[:32], f[:32], f[32:40]), rel=1e-9)
    still = {r["algorithm"]: r for r in sel.evaluate(df, ["product"], ["linear_factors", "knn"], 8, factors="fx").collect()}
    assert still["knn"]["forecast"] == pytest.approx(neighbours(y, f[:40], [f[39]] * 8), rel=1e-9)
    assert still["linear_factors"]["forecast"] == pytest.approx(100 + 0.5 * np.arange(40, 48) + f[39] @ [30, -20], rel=1e-6)


def test_consensus_ignores_spikes(spark):
    y = [10 + 2.0 * i + (-1) ** i * 3 for i in range(30)]
    spiked = [v + (400 if i in (3, 4, 27) else 0) for i, v in enumerate(y)]
    df = spark.createDataFrame([("spiked", spiked), ("three", [1.0, 2.0, 4.0]), ("flat", [5.0] * 20)], "product string, ys array<double>")
    got = {r[0]: r[1:] for r in df.select("product", regression.consensus_slope(F.col("ys")), sm.line(F.col("ys"))["slope"]).collect()}
    assert got["spiked"][0] == pytest.approx(2.0, abs=0.2) and abs(got["spiked"][1] - 2.0) > 0.4
    assert got["three"][0] == got["three"][1] and got["flat"][0] == 0


def test_grid_parameters_are_columns(series):
    out = sel.evaluate_grid(series, ["product"], {"moving_average": {"window_list": [3, 6]}, "knn": {"k_list": [2, 5]}, "linear_regression": {}}, 3)
    got = {(r["product"], r["algorithm"], r["window"], r["k"]): r["forecast"] for r in out.collect()}
    assert len(got) == 5 * series.count()
    for window in (3, 6):
        want = {r[0]: r[1] for r in series.select("product", sm.moving_average(F.col("ys"), 3, window)).collect()}
        assert all(got[p, "moving_average", window, None] == f for p, f in want.items())
