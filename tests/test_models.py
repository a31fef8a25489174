"""Models against plain numpy versions of the same formulas, on series of many lengths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm

H = 8


def series():
    rng = np.random.default_rng(7)
    out = {}
    for n in (2, 3, 5, 6, 7, 9, 12, 23, 24, 30, 61):
        t = np.arange(n)
        out[n] = np.maximum(0, 80 + 0.8 * t + 25 * np.sin(t / 2) + rng.normal(0, 12, n)).round(1)
    out[40] = np.zeros(40)
    out[41] = np.full(41, 12.0)
    out[26] = np.where(np.arange(26) % 3 == 0, 300.0, 5.0)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(n, [float(x) for x in v]) for n, v in series().items()]
    return spark.createDataFrame(rows, "n int, ys array<double>")


def got(frame, model):
    return {r.n: r.f for r in frame.select("n", model(F.col("ys"), H).alias("f")).collect()}


def slope_of(v):
    return np.polyfit(np.arange(len(v)), v, 1)[0] if len(v) > 1 else 0.0


def np_linear(y, h=H):
    a, b = np.polyfit(np.arange(len(y)), y, 1)
    return np.maximum(0, b + a * np.arange(len(y), len(y) + h))


def np_poly(y, h=H, degree=2):
    n = len(y)
    d = 1 if n < 10 else min(degree, 2) if n < 25 else min(degree, 3)
    c = np.polyfit(np.arange(n), y, d)
    w = y[-min(n, 30):]
    pair = [(w[j] - w[i]) / (j - i) for i in range(len(w)) for j in range(i + 1, len(w))]
    trend, recent = np.median(pair), y[-min(12, n):].mean()
    lo, hi = max(recent * 0.5, y.min() * 0.6), min(recent * 1.8, y.max() * 1.3)
    out = []
    for i in range(h):
        p, q = np.polyval(c, n + i), y[-1] + (i + 1) * trend
        mix = 0.6 * p + 0.4 * q if i < 3 else 0.4 * p + 0.6 * q if i < 6 else 0.2 * p + 0.5 * q + 0.3 * recent
        out.append(max(0, min(max(mix, lo), hi)))
    return np.array(out)


def np_smoothing(y, h=H, alphas=sm.DEFAULT_ALPHAS):
    n = len(y)
    if n < 3:
        return np.full(h, y[-1])
    best = None
    for a in alphas:
        w = min(5, n - 1)
        g = a * (1 - a) ** np.arange(w)
        g = g / g.sum()
        x = np.array([[g @ y[i - w:i], i] for i in range(w, n)])
        if len(x) > 1:
            mx, my = x.mean(axis=0), y[w:].mean()
            coef = np.linalg.lstsq(x - mx, y[w:] - my, rcond=1e-9)[0]
            b0 = my - coef @ mx
            rmse = np.sqrt(np.mean((y[w:] - b0 - x @ coef) ** 2))
            win, f = list(y[-w:]), []
            for i in range(h):
                f.append(max(0, b0 + coef @ np.array([g @ np.array(win), n + i])))
                win = win[1:] + [f[-1]]
        else:
            s = [y[0]]
            for v in y[1:]:
                s.append(a * v + (1 - a) * s[-1])
            rmse, f = np.sqrt(np.mean((y[1:] - np.array(s[1:])) ** 2)), [s[-1]] * h
        if best is None or round(rmse, 2) < best[0]:
            best = round(rmse, 2), f
    return np.array(best[1])


def np_average(y, h=H, window=3):
    n = len(y)
    w = min(max(3, window), n)
    s, win, out = slope_of(y[-min(2 * w, n, 12):]), list(y[-w:]), []
    for i in range(h):
        v = max(0, min(max(np.mean(win) + s * 0.95**i, y.min() * 0.5), y.max() * 1.5))
        out.append(v)
        win = win[1:] + [v]
    return np.array(out)


def np_decomposition(y, h=H, season=12):
    n = len(y)
    if n < 2 * season:
        return np_linear(y, h)
    trend = np.convolve(y, np.ones(season) / season, mode="same")
    pattern = [np.mean((y - trend)[i::season]) for i in range(season)]
    a, b = np.polyfit(np.arange(n), trend, 1)
    return np.maximum(0, [a * (n + i) + b + pattern[(n + i) % season] for i in range(h)])


def np_holt_winters(y, h=H, m=12, alpha=0.3, beta=0.1, gamma=0.1):
    n = len(y)
    if n < 2 * m:
        return np_smoothing(y, h)
    mult = y.mean() > 0 and y.std() / y.mean() > 0.3 and y.min() > 0
    level, trend = y[:m].mean(), (y[m:2 * m].mean() - y[:m].mean()) / m
    s = y[: n // m * m].reshape(-1, m).mean(axis=0)
    s = s / level if mult else s - level
    s = s / s.mean() if mult else s - s.mean()
    for i in range(1, n):
        j, old = i % m, level
        level = alpha * (y[i] / s[j] if mult else y[i] - s[j]) + (1 - alpha) * (level + trend)
        trend = beta * (level - old) + (1 - beta) * trend
        s[j] = gamma * (y[i] / level if mult else y[i] - level) + (1 - gamma) * s[j]
    slope, recent, out = slope_of(y[-m:]), y[-m:].mean(), []
    for i in range(h):
        ahead = level + (i + 1) * trend
        hw = ahead * s[(n + i) % m] if mult else ahead + s[(n + i) % m]
        w = max(0.4, 0.7 - 0.3 * i / max(h - 1, 1))
        out.append(max(0, min(max(hw * w + (y[-1] + (i + 1) * slope) * (1 - w), recent * 0.5), recent * 1.6)))
    return np.array(out)


def np_knn(y, h=H, k=5):
    n = len(y)
    if n < k + 5:
        return np_linear(y, h)
    x = np.array([[*y[i - 5:i], i] for i in range(5, n)])
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1)
    z, win, out = (x - mean) / std, list(y[-5:]), []
    for i in range(h):
        d = (((np.array([*win, n + i]) - mean) / std - z) ** 2).sum(axis=1)
        v = max(0, y[5:][np.argsort(d, kind="stable")[:k]].mean())
        out.append(v)
        win = win[1:] + [v]
    return np.array(out)


@pytest.mark.parametrize(
    "model, plain",
    [
        (sm.linear, np_linear), (sm.polynomial, np_poly), (sm.smoothing, np_smoothing), (sm.moving_average, np_average),
        (sm.decomposition, np_decomposition), (sm.holt_winters, np_holt_winters), (sm.knn, np_knn),
    ],
    ids=lambda f: getattr(f, "__name__", ""),
)
def test_model(frame, model, plain):
    out = got(frame, model)
    for n, y in series().items():
        assert out[n] == pytest.approx(list(plain(y)), rel=1e-6, abs=1e-6), n


def test_one_point_series(spark):
    df = spark.createDataFrame([([5.0],)], "ys array<double>")
    row = df.select(
        sm.linear(F.col("ys"), 2).alias("a"), sm.smoothing(F.col("ys"), 2).alias("b"), sm.moving_average(F.col("ys"), 2).alias("c"),
        sm.decomposition(F.col("ys"), 2).alias("d"),
    ).first()
    assert row.a is None and row.d is None and row.b == [5.0, 5.0] and len(row.c) == 2


def test_scores(spark):
    df = spark.createDataFrame([([10.0, 20.0, 0.0], [10.0, 20.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([10.0], [float("nan")]), ([10.0, 10.0], [12.0])], "a array<double>, p array<double>")
    rows = [r.m for r in df.select(sm.score(F.col("a"), F.col("p")).alias("m")).collect()]
    assert (rows[0].accuracy, rows[0].mae, rows[0].mae_accuracy) == (100.0, 0.0, 100.0)
    assert (rows[1].mape, rows[1].accuracy, rows[1].rmse_accuracy) == (100.0, 0.0, 0.0)
    assert (rows[2].mape, rows[2].accuracy) == (None, None)  # unusable input has no score, so it never ranks
    assert rows[3].mape == 20.0 and rows[3].mae == 2.0
