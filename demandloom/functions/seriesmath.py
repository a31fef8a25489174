"""Forecast models as column expressions over one series per row.

A series is an ``array<double>`` in time order, so its length is bounded by the calendar.
Every model is ``f(ys, h, ...) -> array<double>`` of ``h`` future values: fitting and
rolling forward happen inside the row, so any number of models costs no shuffle.
The time index of a value is its position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandloom.functions.scalars import let

def zero() -> Column:
    return F.lit(0.0)

# Smoothing weights tried when none are given, and the wider set.
DEFAULT_ALPHAS = (0.1, 0.3, 0.5)
WIDE_ALPHAS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def pop_std(xs: Column) -> Column:
    return let(xs, lambda v: let(mean(v), lambda m: F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m))))))


def tail(xs: Column, k: Column | int) -> Column:
    """Last ``k`` values; all of them when there are fewer."""
    k = F.lit(k) if isinstance(k, int) else k
    return let(xs, lambda v: let(F.least(k, F.size(v)), lambda m: F.slice(v, F.size(v) - m + 1, m)))


def head(xs: Column, k: Column) -> Column:
    return F.slice(xs, F.lit(1), k)


def at(xs: Column, i: Column) -> Column:
    """Zero-based element."""
    return F.get(xs, i.cast("int"))


def steps(h: Column | int) -> Column:
    h = F.lit(h) if isinstance(h, int) else h
    return F.sequence(F.lit(0), F.greatest(h.cast("int"), F.lit(1)) - 1)


def line(ys: Column) -> Column:
    """Least-squares line over the positions: struct(slope, intercept). One point is flat."""

    def fit(v: Column) -> Column:
        n = F.size(v)
        mid = (n - 1) / 2.0
        sxy = total(F.transform(v, lambda y, i: (i - mid) * y))
        slope = F.coalesce(F.try_divide(sxy, n * (n * n - 1.0) / 12.0), zero())
        return let(
            F.struct(slope.alias("slope"), mean(v).alias("mean"), mid.alias("mid")),
            lambda s: F.struct(
                s["slope"].alias("slope"), (s["mean"] - s["slope"] * s["mid"]).alias("intercept")
            ),
        )

    return let(ys, fit)


# ---------------------------------------------------------------- trend models


def linear(ys: Column, h: Column | int, floor: bool = True) -> Column:
    def roll(v: Column) -> Column:
        def project(f: Column) -> Column:
            def one(k: Column) -> Column:
                y = f["intercept"] + f["slope"] * (F.size(v) + k)
                return F.greatest(y, zero()) if floor else y

            return F.transform(steps(h), one)

        return let(line(v), project)

    return F.when(F.size(ys) >= 2, let(ys, roll))


def linear_fitted(ys: Column) -> Column:
    return let(ys, lambda v: let(line(v), lambda f: F.transform(v, lambda _, i: f["intercept"] + f["slope"] * i)))


def middle_slope(ys: Column) -> Column:
    """Median of the slopes between all points of a short window (at most 30 values)."""

    def slopes(v: Column) -> Column:
        pairs = F.transform(
            v,
            lambda a, i: F.transform(
                F.slice(v, i + 2, F.size(v)), lambda b, j: (b - a) / (j + 1).cast("double")
            ),
        )
        return F.sort_array(F.flatten(pairs))

    def median(s: Column) -> Column:
        m = F.size(s)
        low, high = F.floor((m - 1) / 2), F.floor(m / 2)
        return F.coalesce((at(s, low) + at(s, high)) / 2.0, zero())

    return let(let(ys, slopes), median)


def poly_coefficients(ys: Column, degree: int = 2) -> Column:
    """Coefficients on the orthogonal polynomials of an even grid; unused degrees are 0."""

    def fit(v: Column) -> Column:
        n = F.size(v).cast("double")
        mid = (n - 1) / 2.0
        n2 = n * n
        use = F.when(n < 10, 1).when(n < 25, min(degree, 2)).otherwise(min(degree, 3))
        z = F.transform(v, lambda y, i: F.struct((i - mid).alias("z"), y.alias("y")))

        def on(values: Column) -> Column:
            b1 = total(F.transform(values, lambda s: s["z"] * s["y"]))
            b2 = total(F.transform(values, lambda s: (s["z"] * s["z"] - (n2 - 1) / 12.0) * s["y"]))
            b3 = total(
                F.transform(
                    values,
                    lambda s: (s["z"] * s["z"] * s["z"] - s["z"] * (3 * n2 - 7) / 20.0) * s["y"],
                )
            )
            d1 = n * (n2 - 1) / 12.0
            d2 = d1 * (n2 - 4) / 15.0
            d3 = d2 * (n2 - 9) * 9.0 / 140.0
            return F.struct(
                mean(v).alias("b0"),
                F.coalesce(F.try_divide(b1, d1), zero()).alias("b1"),
                F.when(use >= 2, F.coalesce(F.try_divide(b2, d2), zero())).otherwise(0.0).alias("b2"),
                F.when(use >= 3, F.coalesce(F.try_divide(b3, d3), zero())).otherwise(0.0).alias("b3"),
                mid.alias("mid"),
                n2.alias("n2"),
            )

        return let(z, on)

    return let(ys, fit)


def poly_value(c: Column, x: Column) -> Column:
    z = x - c["mid"]
    return (
        c["b0"]
        + c["b1"] * z
        + c["b2"] * (z * z - (c["n2"] - 1) / 12.0)
        + c["b3"] * (z * z * z - z * (3 * c["n2"] - 7) / 20.0)
    )


def polynomial(ys: Column, h: Column | int, degree: int = 2, trend: Callable[[Column], Column] = middle_slope) -> Column:
    """Polynomial blended with a robust trend and, far out, the recent mean; bounded. ``trend`` gives the slope of the last 30 values."""

    def roll(v: Column) -> Column:
        made = F.struct(
            poly_coefficients(v, degree).alias("c"),
            trend(tail(v, 30)).alias("trend"),
            mean(tail(v, 12)).alias("recent"),
            F.array_min(v).alias("lo"),
            F.array_max(v).alias("hi"),
            F.element_at(v, -1).alias("last"),
        )

        def project(m: Column) -> Column:
            low = F.greatest(m["recent"] * 0.5, m["lo"] * 0.6)
            high = F.least(m["recent"] * 1.8, m["hi"] * 1.3)

            def one(k: Column) -> Column:
                p = poly_value(m["c"], (F.size(v) + k).cast("double"))
                t = m["last"] + (k + 1) * m["trend"]
                mix = (
                    F.when(k < 3, 0.6 * p + 0.4 * t)
                    .when(k < 6, 0.4 * p + 0.6 * t)
                    .otherwise(0.2 * p + 0.5 * t + 0.3 * m["recent"])
                )
                return F.greatest(F.least(F.greatest(mix, low), high), zero())

            return F.transform(steps(h), one)

        return let(made, project)

    return F.when(F.size(ys) >= 2, let(ys, roll))


# ---------------------------------------------------------------- smoothing


def smoothed(ys: Column, alpha: Column | float) -> Column:
    """Simple exponential smoothing level after the last value."""
    return let(
        ys,
        lambda v: F.aggregate(
            F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))),
            F.element_at(v, 1),
            lambda s, y: alpha * y + (1 - alpha) * s,
        ),
    )


def ses(ys: Column, h: Column | int, alpha: Column | float = 0.3) -> Column:
    return let(smoothed(ys, alpha), lambda s: F.transform(steps(h), lambda _: s))


def _ses_rmse(ys: Column, alpha: Column) -> Column:
    """Error of the smoothed levels against the values they smooth, first value left out."""

    def run(v: Column) -> Column:
        state = F.struct(F.element_at(v, 1).alias("s"), F.lit(0.0).alias("e"))

        def step(a: Column, y: Column) -> Column:
            s = alpha * y + (1 - alpha) * a["s"]
            return F.struct(s.alias("s"), (a["e"] + (y - s) * (y - s)).alias("e"))

        done = F.aggregate(F.slice(v, F.lit(2), F.size(v)), state, step)
        return F.sqrt(done["e"] / (F.size(v) - 1))

    return let(ys, run)


def lag_weights(alpha: Column, w: Column) -> Column:
    """Normalised weights; the oldest lag of the window comes first and weighs most."""
    raw = F.transform(F.sequence(F.lit(0), w - 1), lambda j: alpha * F.pow(1.0 - alpha, j))
    return let(raw, lambda r: let(total(r), lambda t: F.transform(r, lambda x: F.try_divide(x, t))))


def _weighted(window: Column, weights: Column) -> Column:
    return total(F.zip_with(window, weights, lambda y, g: y * g))


def smoothing_fit(ys: Column, alpha: Column) -> Column:
    """Regression of each value on (weighted lag mean, index): struct(b0, bs, bt, rmse, m)."""

    def fit(v: Column) -> Column:
        n = F.size(v)

        def with_width(w: Column) -> Column:
            def with_weights(g: Column) -> Column:
                rows = F.transform(
                    F.sequence(w, n - 1),
                    lambda i: F.struct(
                        _weighted(F.slice(v, i - w + 1, w), g).alias("s"),
                        i.cast("double").alias("t"),
                        at(v, i).alias("y"),
                    ),
                )
                return let(rows, lambda r: _two_regressors(r))

            return let(lag_weights(alpha, w), with_weights)

        return let(F.least(F.lit(5), n - 1), with_width)

    return let(ys, fit)


def _two_regressors(rows: Column) -> Column:
    m = F.size(rows)
    means = F.struct(
        mean(F.transform(rows, lambda r: r["s"])).alias("s"),
        mean(F.transform(rows, lambda r: r["t"])).alias("t"),
        mean(F.transform(rows, lambda r: r["y"])).alias("y"),
    )

    def centred(c: Column) -> Column:
        def cov(a: str, b: str) -> Column:
            return total(F.transform(rows, lambda r: (r[a] - c[a]) * (r[b] - c[b])))

        sums = F.struct(
            cov("s", "s").alias("ss"), cov("s", "t").alias("st"), cov("t", "t").alias("tt"),
            cov("s", "y").alias("sy"), cov("t", "y").alias("ty"),
        )

        def solve(q: Column) -> Column:
            det = q["ss"] * q["tt"] - q["st"] * q["st"]
            # Collinear regressors take the smallest solution, as least squares does.
            trace2 = (q["ss"] + q["tt"]) * (q["ss"] + q["tt"])
            full = det > F.lit(1e-10) * q["ss"] * q["tt"]
            bs = F.when(full, F.try_divide(q["sy"] * q["tt"] - q["ty"] * q["st"], det)).otherwise(
                F.coalesce(F.try_divide(q["ss"] * q["sy"] + q["st"] * q["ty"], trace2), zero())
            )
            bt = F.when(full, F.try_divide(q["ty"] * q["ss"] - q["sy"] * q["st"], det)).otherwise(
                F.coalesce(F.try_divide(q["st"] * q["sy"] + q["tt"] * q["ty"], trace2), zero())
            )
            return F.struct(bs.alias("bs"), bt.alias("bt"))

        def score(b: Column) -> Column:
            b0 = c["y"] - b["bs"] * c["s"] - b["bt"] * c["t"]

            def with_intercept(k: Column) -> Column:
                sq = F.transform(
                    rows, lambda r: F.pow(r["y"] - k - b["bs"] * r["s"] - b["bt"] * r["t"], F.lit(2.0))
                )
                return F.struct(
                    k.alias("b0"), b["bs"].alias("bs"), b["bt"].alias("bt"),
                    F.sqrt(mean(sq)).alias("rmse"), m.alias("m"),
                )

            return let(b0, with_intercept)

        return let(let(sums, solve), score)

    return let(means, centred)


def smoothing_rollout(ys: Column, h: Column | int, alpha: Column, fit: Column) -> Column:
    def roll(v: Column) -> Column:
        n = F.size(v)

        def with_width(w: Column) -> Column:
            def with_weights(g: Column) -> Column:
                start = F.struct(tail(v, w).alias("win"), F.array().cast("array<double>").alias("out"))

                def step(a: Column, k: Column) -> Column:
                    p = fit["b0"] + fit["bs"] * _weighted(a["win"], g) + fit["bt"] * (n + k)
                    return let(
                        F.greatest(p, zero()),
                        lambda y: F.struct(
                            F.concat(F.slice(a["win"], F.lit(2), w), F.array(y)).alias("win"),
                            F.concat(a["out"], F.array(y)).alias("out"),
                        ),
                    )

                return F.aggregate(steps(h), start, step, lambda a: a["out"])

            return let(lag_weights(alpha, w), with_weights)

        return let(F.least(F.lit(5), n - 1), with_width)

    return let(ys, roll)


def smoothing(ys: Column, h: Column | int, alphas: Sequence[float] = DEFAULT_ALPHAS) -> Column:
    """Windowed smoothing regression; the weight with the lowest in-sample error wins."""

    def one(v: Column, order: Column, alpha: Column) -> Column:
        def with_fit(f: Column) -> Column:
            return F.when(
                f["m"] > 1,
                F.struct(
                    F.round(f["rmse"], 2).alias("rmse"), order.alias("pos"),
                    smoothing_rollout(v, h, alpha, f).alias("f"),
                ),
            ).otherwise(
                F.struct(
                    F.round(_ses_rmse(v, alpha), 2).alias("rmse"), order.alias("pos"),
                    ses(v, h, alpha).alias("f"),
                )
            )

        return let(smoothing_fit(v, alpha), with_fit)

    def best(v: Column) -> Column:
        tried = F.transform(F.array(*[F.lit(float(a)) for a in alphas]), lambda a, i: one(v, i, a))
        return F.array_min(tried)["f"]

    flat = let(ys, lambda v: F.transform(steps(h), lambda _: F.element_at(v, -1)))
    return F.when(F.size(ys) < 3, flat).otherwise(let(ys, best))


# ---------------------------------------------------------------- seasonal


def holt_winters(
    ys: Column, h: Column | int, season: int = 12, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1
) -> Column:
    """Level, trend and season; multiplicative for positive volatile series; damped rollout."""

    def start(v: Column) -> Column:
        n = F.size(v)
        level = mean(F.slice(v, 1, season))
        trend = (mean(F.slice(v, season + 1, season)) - level) / season
        multiplicative = (F.coalesce(F.try_divide(pop_std(v), mean(v)), zero()) > 0.3) & (F.array_min(v) > 0)
        cycles = F.floor(n / season)
        position_means = F.transform(
            F.sequence(F.lit(0), F.lit(season - 1)),
            lambda p: mean(F.transform(F.sequence(F.lit(0), (cycles - 1).cast("int")), lambda j: at(v, p + j * season))),
        )
        return F.struct(
            level.alias("level"), trend.alias("trend"), multiplicative.alias("mult"), position_means.alias("pm")
        )

    def seasons(s: Column) -> Column:
        raw = F.transform(s["pm"], lambda m: F.when(s["mult"], F.try_divide(m, s["level"])).otherwise(m - s["level"]))
        return let(
            raw,
            lambda r: let(
                mean(r),
                lambda m: F.transform(r, lambda x: F.when(s["mult"], F.try_divide(x, m)).otherwise(x - m)),
            ),
        )

    def fit(v: Column, s: Column, first: Column) -> Column:
        state = F.struct(s["level"].alias("level"), s["trend"].alias("trend"), first.alias("sea"))

        def step(a: Column, i: Column) -> Column:
            p = (i % season).cast("int")
            y, old = at(v, i), at(a["sea"], p)
            base = (1 - alpha) * (a["level"] + a["trend"])
            level = alpha * F.when(s["mult"], F.try_divide(y, old)).otherwise(y - old) + base

            def with_level(new: Column) -> Column:
                moved = F.when(s["mult"], F.try_divide(y, new)).otherwise(y - new)
                return F.struct(
                    new.alias("level"),
                    (beta * (new - a["level"]) + (1 - beta) * a["trend"]).alias("trend"),
                    F.transform(
                        a["sea"], lambda x, j: F.when(j == p, gamma * moved + (1 - gamma) * x).otherwise(x)
                    ).alias("sea"),
                )

            return let(level, with_level)

        return F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), state, step)

    def project(v: Column, s: Column, f: Column) -> Column:
        last_season = tail(v, season)
        hh = F.lit(h) if isinstance(h, int) else h
        made = F.struct(
            line(last_season)["slope"].alias("slope"), mean(last_season).alias("recent"),
            F.element_at(v, -1).alias("last"),
        )

        def out(m: Column) -> Column:
            def one(k: Column) -> Column:
                sea = at(f["sea"], (F.size(v) + k) % season)
                ahead = f["level"] + (k + 1) * f["trend"]
                hw = F.when(s["mult"], ahead * sea).otherwise(ahead + sea)
                calm = m["last"] + (k + 1) * m["slope"]
                w = F.greatest(F.lit(0.4), 0.7 - 0.3 * k / F.greatest(hh - 1, F.lit(1)))
                mix = hw * w + calm * (1 - w)
                return F.greatest(F.least(F.greatest(mix, m["recent"] * 0.5), m["recent"] * 1.6), zero())

            return F.transform(steps(h), one)

        return let(made, out)

    long_enough = let(
        ys,
        lambda v: let(start(v), lambda s: let(let(seasons(s), lambda first: fit(v, s, first)), lambda f: project(v, s, f))),
    )
    return F.when(F.size(ys) >= 2 * season, long_enough).otherwise(smoothing(ys, h))


def centred_mean(ys: Column, season: int = 12) -> Column:
    """Centred moving sum over ``season`` values divided by ``season``; zeros beyond the ends."""
    back, ahead = season // 2, (season - 1) // 2

    def at_each(v: Column) -> Column:
        return F.transform(
            v,
            lambda _, i: let(
                F.greatest(i - back, F.lit(0)),
                lambda a: total(F.slice(v, a + 1, F.least(i + ahead, F.size(v) - 1) - a + 1)) / season,
            ),
        )

    return let(ys, at_each)


def decomposition(ys: Column, h: Column | int, season: int = 12) -> Column:
    def roll(v: Column) -> Column:
        def with_trend(tr: Column) -> Column:
            rest = F.zip_with(v, tr, lambda y, t: y - t)

            def with_rest(d: Column) -> Column:
                pattern = F.transform(
                    F.sequence(F.lit(0), F.lit(season - 1)),
                    lambda p: mean(F.filter(d, lambda _, i: i % season == p)),
                )
                return let(
                    pattern,
                    lambda sea: let(
                        line(tr),
                        lambda f: F.transform(
                            steps(h),
                            lambda k: F.greatest(
                                f["intercept"] + f["slope"] * (F.size(v) + k) + at(sea, (F.size(v) + k) % season),
                                zero(),
                            ),
                        ),
                    ),
                )

            return let(rest, with_rest)

        return let(centred_mean(v, season), with_trend)

    return F.when(F.size(ys) >= 2 * season, let(ys, roll)).otherwise(linear(ys, h))


# ---------------------------------------------------------------- moving average


def moving_average(ys: Column, h: Column | int, window: Column | int = 3) -> Column:
    """Rolling mean plus a damped recent slope, fed back into the window; bounded."""

    def roll(v: Column) -> Column:
        n = F.size(v)
        w = F.least(F.greatest(F.lit(3), F.lit(window) if isinstance(window, int) else window), n)
        made = F.struct(
            line(tail(v, F.least(w * 2, n, F.lit(12))))["slope"].alias("slope"),
            F.greatest(F.array_min(v) * 0.5, zero()).alias("lo"),
            (F.array_max(v) * 1.5).alias("hi"),
            w.alias("w"),
        )

        def project(m: Column) -> Column:
            start = F.struct(tail(v, m["w"]).alias("win"), F.array().cast("array<double>").alias("out"))

            def step(a: Column, k: Column) -> Column:
                y = mean(a["win"]) + m["slope"] * F.pow(F.lit(0.95), k)
                return let(
                    F.greatest(F.least(F.greatest(y, m["lo"]), m["hi"]), zero()),
                    lambda x: F.struct(
                        F.concat(F.slice(a["win"], F.lit(2), m["w"]), F.array(x)).alias("win"),
                        F.concat(a["out"], F.array(x)).alias("out"),
                    ),
                )

            return F.aggregate(steps(h), start, step, lambda a: a["out"])

        return let(made, project)

    return F.when(F.size(ys) >= 1, let(ys, roll))


# ---------------------------------------------------------------- neighbours


def lag_rows(ys: Column, lags: int = 5, factors: Column | None = None) -> Column:
    """Training rows: struct(x = lags oldest first + index + factors of the position, y)."""

    def rows(v: Column) -> Column:
        def one(i: Column) -> Column:
            x = F.concat(F.slice(v, i - lags + 1, F.lit(lags)), F.array(i.cast("double")))
            if factors is not None:
                x = F.concat(x, at(factors, i))
            return F.struct(x.alias("x"), at(v, i).alias("y"))

        return F.transform(F.sequence(F.lit(lags), F.size(v) - 1), one)

    return F.when(F.size(ys) > lags, let(ys, rows))


def knn(ys: Column, h: Column | int, k: Column | int = 5, lags: int = 5, factors: Column | None = None, future: Column | None = None) -> Column:
    """Mean of the k nearest standardised lag rows, fed back step by step.

    ``future`` has a row of factor values for each step; without it the last known ones stay.
    """
    k = F.lit(k) if isinstance(k, int) else k

    def scale(rows: Column) -> Column:
        width = F.size(F.element_at(rows, 1)["x"])
        return F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda f: let(
                F.transform(rows, lambda r: at(r["x"], f)),
                lambda c: let(
                    pop_std(c),
                    lambda s: F.struct(mean(c).alias("m"), F.when(s > 0, s).otherwise(1.0).alias("s")),
                ),
            ),
        )

    def scaled(x: Column, sc: Column) -> Column:
        return F.zip_with(x, sc, lambda a, b: (a - b["m"]) / b["s"])

    def roll(v: Column) -> Column:
        def with_rows(rows: Column) -> Column:
            def with_scale(sc: Column) -> Column:
                train = F.transform(rows, lambda r: F.struct(scaled(r["x"], sc).alias("x"), r["y"].alias("y")))

                def with_train(tr: Column) -> Column:
                    start = F.struct(tail(v, lags).alias("win"), F.array().cast("array<double>").alias("out"))

                    def nearest(q: Column) -> Column:
                        near = F.transform(
                            tr,
                            lambda r, i: F.struct(
                                total(F.zip_with(r["x"], q, lambda a, b: (a - b) * (a - b))).alias("d"),
                                i.alias("i"), r["y"].alias("y"),
                            ),
                        )
                        return mean(F.transform(F.slice(F.sort_array(near), F.lit(1), k), lambda r: r["y"]))

                    def step(a: Column, j: Column) -> Column:
                        x = F.concat(a["win"], F.array((F.size(v) + j).cast("double")))
                        if factors is not None:
                            last = F.element_at(factors, -1)
                            x = F.concat(x, last if future is None else F.coalesce(F.get(future, j), last))
                        return let(
                            F.greatest(let(scaled(x, sc), nearest), zero()),
                            lambda y: F.struct(
                                F.concat(F.slice(a["win"], F.lit(2), F.lit(lags)), F.array(y)).alias("win"),
                                F.concat(a["out"], F.array(y)).alias("out"),
                            ),
                        )

                    return F.aggregate(steps(h), start, step, lambda a: a["out"])

                return let(train, with_train)

            return let(scale(rows), with_scale)

        return let(lag_rows(v, lags, factors), with_rows)

    return F.when(F.size(ys) >= k + lags, let(ys, roll)).otherwise(linear(ys, h))


# ---------------------------------------------------------------- autoregression


def differences(ys: Column, lag: int = 1) -> Column:
    return let(
        ys,
        lambda v: F.when(
            F.size(v) > lag,
            F.transform(F.sequence(F.lit(lag), F.size(v) - 1), lambda i: at(v, i) - at(v, i - lag)),
        ).otherwise(F.array().cast("array<double>")),
    )


def ar1(ds: Column) -> Column:
    """Least squares of each value on the one before: struct(c, phi)."""

    def fit(d: Column) -> Column:
        m = F.size(d) - 1
        pairs = F.transform(
            F.sequence(F.lit(1), m), lambda i: F.struct(at(d, i - 1).alias("x"), at(d, i).alias("y"))
        )

        def solve(p: Column) -> Column:
            means = F.struct(
                mean(F.transform(p, lambda r: r["x"])).alias("x"), mean(F.transform(p, lambda r: r["y"])).alias("y")
            )

            def with_means(c: Column) -> Column:
                sxx = total(F.transform(p, lambda r: (r["x"] - c["x"]) * (r["x"] - c["x"])))
                sxy = total(F.transform(p, lambda r: (r["x"] - c["x"]) * (r["y"] - c["y"])))
                return let(
                    F.coalesce(F.try_divide(sxy, sxx), zero()),
                    lambda phi: F.struct((c["y"] - phi * c["x"]).alias("c"), phi.alias("phi")),
                )

            return let(means, with_means)

        flat = F.struct(F.coalesce(mean(d), zero()).alias("c"), F.lit(0.0).alias("phi"))
        return F.when(F.size(d) >= 2, let(pairs, solve)).otherwise(flat)

    return let(ds, fit)


def _ari_path(v: Column, h: Column | int) -> Column:
    """Unfloored path of the integrated AR(1)."""

    def with_diff(d: Column) -> Column:
        def roll(f: Column) -> Column:
            start = F.struct(
                F.element_at(v, -1).alias("y"), F.coalesce(F.get(d, F.size(d) - 1), zero()).alias("d"),
                F.array().cast("array<double>").alias("out"),
            )

            def step(a: Column, _: Column) -> Column:
                return let(
                    f["c"] + f["phi"] * a["d"],
                    lambda nd: F.struct(
                        (a["y"] + nd).alias("y"), nd.alias("d"),
                        F.concat(a["out"], F.array(a["y"] + nd)).alias("out"),
                    ),
                )

            return F.aggregate(steps(h), start, step, lambda a: a["out"])

        return let(ar1(d), roll)

    return let(differences(v), with_diff)


def ari(ys: Column, h: Column | int) -> Column:
    """Integrated first-order autoregression by least squares, without a moving-average term."""
    path = let(ys, lambda v: F.transform(_ari_path(v, h), lambda y: F.greatest(y, zero())))
    return F.when(F.size(ys) >= 2, path)


def seasonal_ari(ys: Column, h: Column | int, season: int = 12) -> Column:
    """The same after a seasonal difference; series under two seasons skip the difference."""

    def roll(v: Column) -> Column:
        def undo(s: Column) -> Column:
            start = F.struct(tail(v, season).alias("win"), F.array().cast("array<double>").alias("out"))

            def step(a: Column, x: Column) -> Column:
                return let(
                    F.element_at(a["win"], 1) + x,
                    lambda y: F.struct(
                        F.concat(F.slice(a["win"], F.lit(2), F.lit(season)), F.array(y)).alias("win"),
                        F.concat(a["out"], F.array(F.greatest(y, zero()))).alias("out"),
                    ),
                )

            return F.aggregate(s, start, step, lambda a: a["out"])

        return let(let(differences(v, season), lambda d: _ari_path(d, h)), undo)

    return F.when(F.size(ys) >= 2 * season, let(ys, roll)).otherwise(ari(ys, h))


# ---------------------------------------------------------------- scoring


def train_length(n: Column, ratio: float = 0.8) -> Column:
    """Rows used for training; all of them when the series is too short to hold any back."""
    cut = F.least(F.greatest(F.lit(2), F.floor(n * ratio)), n - 1)
    return F.when(n < 4, n).otherwise(cut).cast("int")


def score(actual: Column, predicted: Column) -> Column:
    """Accuracy figures of two arrays, cut to the shorter; NULL figures for missing, empty or non-finite input."""

    def pairs(a: Column, p: Column) -> Column:
        m = F.least(F.size(a), F.size(p))
        return F.arrays_zip(F.slice(a, F.lit(1), m).alias("a"), F.slice(p, F.lit(1), m).alias("p"))

    def figures(z: Column) -> Column:
        bad = F.exists(
            z,
            lambda r: r["a"].isNull() | r["p"].isNull() | F.isnan(r["a"]) | F.isnan(r["p"])
            | (F.abs(r["a"]) == F.lit(float("inf"))) | (F.abs(r["p"]) == F.lit(float("inf"))),
        ) | (F.size(z) == 0)
        nonzero = F.filter(z, lambda r: r["a"] != 0)
        raw = F.struct(
            mean(F.transform(z, lambda r: r["a"])).alias("mean"),
            mean(F.transform(z, lambda r: F.abs(r["a"] - r["p"]))).alias("mae"),
            F.sqrt(mean(F.transform(z, lambda r: F.pow(r["a"] - r["p"], F.lit(2.0))))).alias("rmse"),
            F.coalesce(
                mean(F.transform(nonzero, lambda r: F.abs((r["a"] - r["p"]) / r["a"]))) * 100, F.lit(100.0)
            ).alias("mape"),
        )
        none = metric_struct(*[F.lit(None).cast("double")] * 6)
        return F.when(~F.coalesce(bad, F.lit(True)), let(raw, rounded_metrics)).otherwise(none)

    return let(F.struct(actual.alias("a"), predicted.alias("p")), lambda s: let(pairs(s["a"], s["p"]), figures))


def metric_struct(mae, rmse, mape, accuracy, mae_accuracy, rmse_accuracy) -> Column:
    return F.struct(
        mae.alias("mae"), rmse.alias("rmse"), mape.alias("mape"), accuracy.alias("accuracy"),
        mae_accuracy.alias("mae_accuracy"), rmse_accuracy.alias("rmse_accuracy"),
    )


def rounded_metrics(r: Column) -> Column:
    """From raw (mean, mae, rmse, mape) to the published figures."""
    mape = F.round(F.least(r["mape"], F.lit(100.0)), 2)

    def relative(err: Column) -> Column:
        left = 100.0 - F.try_divide(err, r["mean"]) * 100
        return F.when(r["mean"] > 0, F.round(F.greatest(left, zero()), 2)).otherwise(0.0)

    return metric_struct(
        F.round(r["mae"], 2), F.round(r["rmse"], 2), mape, F.round(F.greatest(100.0 - mape, zero()), 2),
        relative(r["mae"]), relative(r["rmse"]),
    )


# Name of each model as a request spells it.
MODELS = {
    "linear_regression": linear,
    "polynomial_regression": polynomial,
    "exponential_smoothing": smoothing,
    "enhanced_exponential_smoothing": lambda ys, h, alphas=WIDE_ALPHAS: smoothing(ys, h, alphas),
    "simple_exponential_smoothing": ses,
    "holt_winters": holt_winters,
    "moving_average": moving_average,
    "simple_moving_average": moving_average,
    "seasonal_decomposition": decomposition,
    "knn": knn,
    "arima": ari,
    "sarima": seasonal_ari,
}
