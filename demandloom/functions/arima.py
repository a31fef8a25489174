"""Integrated autoregression with a moving-average term, and the choice of its order, inside a row.

Two regressions estimate a model: a longer autoregression gives innovations, then values are regressed on
their own lags and on lagged innovations. An innovations recursion as a fold gives the conditional sum of
squares and the state the forecast starts from. Orders can be columns, so one plan serves many orders.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm
from demandloom.functions.regression import dot, indices, least_squares
from demandloom.functions.scalars import let

MOST = 2
# Seasonal strength that asks for a seasonal difference, and the 5 % point of the level stationarity statistic.
STRONG_SEASON, STATIONARY = 0.64, 0.463


def _column(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def differenced(ys: Column, d: Column | int) -> Column:
    """The series after ``d`` differences, 0 to 2."""
    return let(ys, lambda v: F.when(_column(d) == 0, v).when(_column(d) == 1, sm.differences(v)).otherwise(sm.differences(sm.differences(v))))


def _lags(w: Column, t: Column, k: Column) -> Column:
    """The ``k`` values before position t, oldest first."""
    return F.slice(w, t - k + 1, k)


def stable(weights: Column) -> Column:
    """Whether a recursion with these one or two weights, oldest lag first, dies out."""
    lag = lambda k: F.coalesce(F.get(weights, F.size(weights) - k), sm.zero())
    a, b = lag(1), lag(2)
    return (F.abs(b) < 1) & (a + b < 1) & (b - a < 1)


def fit(w: Column, p: Column | int, q: Column | int, burn: Column | int | None = None) -> Column:
    """struct(c, phi, theta, css, m, es) of a stationary series; null where it is too short,
    or where the estimates make a recursion that does not die out (not stationary or not invertible).

    ``phi`` and ``theta`` are oldest lag first, ``es`` the last innovations, ``css`` their sum of squares
    from position ``burn`` on (by default the larger order) over ``m`` values.
    """
    p, q = _column(p), _column(q)
    first = F.greatest(p, q) if burn is None else _column(burn)

    def rows(v: Column, begin: Column, x) -> Column:
        at = F.transform(indices(F.size(v) - begin), lambda i: i + begin)
        return let(F.struct(F.transform(at, x).alias("x"), F.transform(at, lambda t: sm.at(v, t)).alias("y")), lambda s: least_squares(s["x"], s["y"]))

    def estimate(v: Column) -> Column:
        n, long = F.size(v), F.greatest(p, q) + 1

        def innovations(f: Column) -> Column:
            return F.transform(v, lambda y, t: F.when(t < long, sm.zero()).otherwise(y - f["intercept"] - dot(f["weights"], _lags(v, t, long))))

        none = F.transform(v, lambda _: sm.zero())
        rough = F.when(q == 0, none).otherwise(let(rows(v, long, lambda t: _lags(v, t, long)), innovations))

        def refine(e: Column) -> Column:
            begin = F.when(q == 0, p).otherwise(long + q)
            fitted = rows(v, begin, lambda t: F.concat(_lags(v, t, p), _lags(e, t, q)))
            flat = F.struct(sm.mean(v).alias("intercept"), F.array().cast("array<double>").alias("weights"))
            return let(F.when(p + q == 0, flat).otherwise(fitted), recurse)

        def recurse(f: Column) -> Column:
            phi, theta = F.slice(f["weights"], F.lit(1), p), F.slice(f["weights"], p + 1, q)

            def with_weights(s: Column) -> Column:
                start = F.struct(F.transform(indices(q), lambda _: sm.zero()).alias("es"), sm.zero().alias("css"), F.lit(0).alias("m"))

                def step(a: Column, t: Column) -> Column:
                    e = sm.at(v, t) - f["intercept"] - dot(s["phi"], _lags(v, t, p)) - dot(s["theta"], a["es"])
                    return let(
                        e,
                        lambda x: F.struct(
                            F.slice(F.concat(a["es"], F.array(x)), F.lit(2), q).alias("es"),
                            (a["css"] + F.when(t >= first, x * x).otherwise(0.0)).alias("css"), (a["m"] + F.when(t >= first, 1).otherwise(0)).alias("m"),
                        ),
                    )

                begin = F.greatest(p, q)
                done = F.aggregate(F.transform(indices(n - begin), lambda i: i + begin), start, step)
                steady = stable(s["phi"]) & stable(F.transform(s["theta"], lambda x: -x))
                return F.when(steady, let(done, lambda a: F.struct(f["intercept"].alias("c"), s["phi"].alias("phi"), s["theta"].alias("theta"), a["css"].alias("css"), a["m"].alias("m"), a["es"].alias("es"))))

            return let(F.struct(phi.alias("phi"), theta.alias("theta")), with_weights)

        return let(rough, refine)

    return F.when(F.size(w) >= 3 * (p + q) + 6, let(w, estimate))


def _path(w: Column, f: Column, h: Column | int) -> Column:
    """Values after the end of the stationary series."""
    p, q = F.size(f["phi"]), F.size(f["theta"])
    start = F.struct(F.slice(w, F.size(w) - p + 1, p).alias("win"), f["es"].alias("es"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        return let(
            f["c"] + dot(f["phi"], a["win"]) + dot(f["theta"], a["es"]),
            lambda y: F.struct(
                F.slice(F.concat(a["win"], F.array(y)), F.lit(2), p).alias("win"), F.slice(F.concat(a["es"], F.array(sm.zero())), F.lit(2), q).alias("es"),
                F.concat(a["out"], F.array(y)).alias("out"),
            ),
        )

    return F.aggregate(sm.steps(h), start, step, lambda a: a["out"])


def _summed(path: Column, last: Column) -> Column:
    """Values whose differences are the path, after the last known one."""
    start = F.struct(last.alias("y"), F.array().cast("array<double>").alias("out"))
    step = lambda a, x: F.struct((a["y"] + x).alias("y"), F.concat(a["out"], F.array(a["y"] + x)).alias("out"))
    return F.aggregate(path, start, step, lambda a: a["out"])


def _ahead(v: Column, h: Column | int, f: Column, d: Column) -> Column:
    """Unfloored values after the series whose ``d``-th difference the model was fitted to."""
    path = _path(differenced(v, d), f, h)
    once = lambda x: _summed(x, F.element_at(v, -1))
    twice = lambda x: once(_summed(x, F.element_at(sm.differences(v), -1)))
    return let(path, lambda x: F.when(d == 0, x).when(d == 1, once(x)).otherwise(twice(x)))


def arima(ys: Column, h: Column | int, p: Column | int = 1, d: Column | int = 1, q: Column | int = 1) -> Column:
    """Forecast of the order (p, d, q), each 0 to 2, ints or columns. Series without a fit of it get their line."""
    d = _column(d)

    def roll(v: Column) -> Column:
        return let(fit(differenced(v, d), p, q), lambda f: F.when(f.isNotNull(), F.transform(_ahead(v, h, f, d), lambda y: F.greatest(y, sm.zero()))).otherwise(sm.linear(v, h)))

    return F.when(F.size(ys) >= 2, let(ys, roll))


# ---------------------------------------------------------------- order choice


def seasonal_strength(ys: Column, season: int = 12) -> Column:
    """Share of the detrended variance that the seasonal pattern explains, 0 to 1."""

    def of(rest: Column) -> Column:
        pattern = F.transform(F.sequence(F.lit(0), F.lit(season - 1)), lambda p: sm.mean(F.filter(rest, lambda _, i: i % season == p)))
        left = let(pattern, lambda s: F.transform(rest, lambda x, i: x - sm.at(s, i % season)))
        var = lambda x: F.pow(sm.pop_std(x), F.lit(2.0))
        return F.greatest(1.0 - F.coalesce(F.try_divide(var(left), var(rest)), F.lit(1.0)), sm.zero())

    return let(ys, lambda v: let(F.zip_with(v, sm.centred_mean(v, season), lambda y, t: y - t), of))


def level_statistic(ys: Column) -> Column:
    """Squared partial sums of the series around its mean over their long-run variance; large where the level drifts."""

    def of(x: Column) -> Column:
        n = F.size(x)
        lags = F.floor(4 * F.pow(n / 100.0, F.lit(0.25))).cast("int")
        start = F.struct(sm.zero().alias("s"), sm.zero().alias("total"))
        sums = F.aggregate(x, start, lambda a, e: F.struct((a["s"] + e).alias("s"), (a["total"] + (a["s"] + e) * (a["s"] + e)).alias("total")), lambda a: a["total"])
        cov = lambda k: dot(F.slice(x, k + 1, n - k), F.slice(x, F.lit(1), n - k))
        spread = dot(x, x) + 2 * sm.total(F.transform(indices(lags), lambda i: (1.0 - (i + 1) / (lags + 1.0)) * cov(i + 1)))
        return F.coalesce(F.try_divide(sums, n * spread), sm.zero())

    return let(ys, lambda v: let(sm.mean(v), lambda m: let(F.transform(v, lambda y: y - m), of)))


def differences_needed(ys: Column) -> Column:
    """How many differences, 0 to 2, bring the level statistic under its 5 % point."""
    drifts = lambda v: level_statistic(v) > STATIONARY
    return let(ys, lambda v: F.when(~drifts(v), 0).when(~let(sm.differences(v), drifts), 1).otherwise(2))


def chosen_order(ys: Column, season: int = 12, most: int = MOST) -> Column:
    """struct(seasonal, p, d, q, aicc): the order that the corrected information criterion likes best.

    The seasonal difference follows the seasonal strength and the others the level statistic; then all p
    and q up to ``most`` are fitted in the row and scored over the same values. Equal scores (to six digits) take the smaller order.
    """

    def search(v: Column) -> Column:
        seasonal = (F.size(v) >= 2 * season) & (seasonal_strength(v, season) > STRONG_SEASON)

        def with_season(s: Column) -> Column:
            def with_d(u: Column) -> Column:
                orders = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(most + 1) for q in range(most + 1)])

                def score(o: Column) -> Column:
                    def with_fit(f: Column) -> Column:
                        k, m = o["p"] + o["q"] + 2, f["m"]
                        aicc = m * F.log(f["css"] / m) + 2.0 * k + 2.0 * k * (k + 1) / F.greatest(m - k - 1, F.lit(1))
                        return F.struct(F.coalesce(F.round(aicc, 6), F.lit(float("inf"))).alias("aicc"), o["p"].alias("p"), o["q"].alias("q"))

                    return let(fit(u["w"], o["p"], o["q"], most), with_fit)

                best = F.array_min(F.transform(orders, score))
                return let(best, lambda b: F.struct(s["seasonal"].alias("seasonal"), b["p"].alias("p"), u["d"].alias("d"), b["q"].alias("q"), b["aicc"].alias("aicc")))

            return let(let(differences_needed(s["u"]), lambda d: F.struct(d.alias("d"), differenced(s["u"], d).alias("w"))), with_d)

        return let(let(seasonal, lambda s: F.struct(s.alias("seasonal"), F.when(s, sm.differences(v, season)).otherwise(v).alias("u"))), with_season)

    return let(ys, search)


def auto_sarima(ys: Column, h: Column | int, season: int = 12, most: int = MOST) -> Column:
    """Forecast with the chosen order, the seasonal difference undone; series without a fit get their line."""

    def roll(v: Column, o: Column) -> Column:
        def with_u(u: Column) -> Column:
            def with_path(path: Column) -> Column:
                start = F.struct(sm.tail(v, season).alias("win"), F.array().cast("array<double>").alias("out"))

                def step(a: Column, x: Column) -> Column:
                    return let(
                        F.element_at(a["win"], 1) + x,
                        lambda y: F.struct(F.concat(F.slice(a["win"], F.lit(2), F.lit(season)), F.array(y)).alias("win"), F.concat(a["out"], F.array(y)).alias("out")),
                    )

                out = F.when(o["seasonal"], F.aggregate(path, start, step, lambda a: a["out"])).otherwise(path)
                return F.transform(out, lambda y: F.greatest(y, sm.zero()))

            fitted = fit(differenced(u, o["d"]), o["p"], o["q"])
            return let(fitted, lambda f: F.when(f.isNotNull(), let(_ahead(u, h, f, o["d"]), with_path)).otherwise(sm.linear(v, h)))

        return let(F.when(o["seasonal"], sm.differences(v, season)).otherwise(v), with_u)

    return F.when(F.size(ys) >= 12, let(ys, lambda v: let(chosen_order(v, season, most), lambda o: roll(v, o)))).otherwise(sm.linear(ys, h))
