"""Least squares inside a row: matrices are arrays of arrays, bounded by the calendar and the model's width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm
from demandloom.functions.scalars import let

# Pivots of a correlation matrix below this are dependent columns; the ridge then shares their weight.
TOLERANCE, RIDGE = 1e-9, 1e-6


def indices(n: Column | int) -> Column:
    """0 to n - 1; none for n = 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.array_repeat(F.lit(0), n.cast("int")), lambda _, i: i)


def dot(a: Column, b: Column) -> Column:
    return sm.total(F.zip_with(a, b, lambda x, y: x * y))


def solve(matrix: Column, right: Column) -> Column:
    """struct(x, ok) with matrix x = right by elimination; ``ok`` is false where a pivot vanishes."""
    start = F.struct(F.zip_with(matrix, right, lambda row, y: F.concat(row, F.array(y))).alias("m"), F.lit(True).alias("ok"))

    def step(s: Column, k: Column) -> Column:
        def eliminate(row: Column) -> Column:
            def with_unit(unit: Column) -> Column:
                rows = F.transform(s["m"], lambda r, i: F.when(i == k, unit).otherwise(F.zip_with(r, unit, lambda x, u: x - F.get(r, k) * u)))
                return F.struct(rows.alias("m"), (s["ok"] & (F.get(row, k) > TOLERANCE)).alias("ok"))

            return let(F.transform(row, lambda x: F.try_divide(x, F.get(row, k))), with_unit)

        return let(F.get(s["m"], k), eliminate)

    return F.aggregate(indices(F.size(matrix)), start, step, lambda s: F.struct(F.transform(s["m"], lambda r: F.element_at(r, -1)).alias("x"), s["ok"].alias("ok")))


def least_squares(xs: Column, ys: Column) -> Column:
    """struct(intercept, weights) of ys on the rows xs. Columns that depend on others share their weight by a small ridge."""

    def standard(rows: Column, values: Column) -> Column:
        width = F.size(F.element_at(rows, 1))

        def column(j: Column) -> Column:
            return let(
                F.transform(rows, lambda r: F.get(r, j)),
                lambda c: let(sm.pop_std(c), lambda s: F.struct(sm.mean(c).alias("m"), F.when(s > 0, s).otherwise(1.0).alias("s"))),
            )

        def fit(stats: Column) -> Column:
            z = F.transform(rows, lambda r: F.zip_with(r, stats, lambda x, s: (x - s["m"]) / s["s"]))

            def with_z(z: Column) -> Column:
                side = F.transform(indices(width), lambda j: F.transform(z, lambda r: F.get(r, j)))

                def with_columns(c: Column) -> Column:
                    middle = sm.mean(values)
                    matrix = F.transform(c, lambda a: F.transform(c, lambda b: dot(a, b) / F.size(values)))
                    right = let(middle, lambda m: F.transform(c, lambda a: sm.total(F.zip_with(a, values, lambda x, y: x * (y - m))) / F.size(values)))
                    eased = lambda m: F.transform(m, lambda r, i: F.transform(r, lambda x, j: F.when(i == j, x + RIDGE).otherwise(x)))

                    def solved(q: Column) -> Column:
                        return let(solve(q["a"], q["b"]), lambda s: F.when(s["ok"], s["x"]).otherwise(solve(eased(q["a"]), q["b"])["x"]))

                    def back(w: Column) -> Column:
                        own = F.zip_with(w, stats, lambda x, s: x / s["s"])
                        return let(own, lambda o: F.struct((middle - sm.total(F.zip_with(o, stats, lambda x, s: x * s["m"]))).alias("intercept"), o.alias("weights")))

                    return let(let(F.struct(matrix.alias("a"), right.alias("b")), solved), back)

                return let(side, with_columns)

            return let(z, with_z)

        return let(F.transform(indices(width), column), fit)

    return let(F.struct(xs.alias("x"), ys.alias("y")), lambda s: standard(s["x"], s["y"]))


def value(fit: Column, x: Column) -> Column:
    return fit["intercept"] + dot(fit["weights"], x)


# ---------------------------------------------------------------- factors


def factor_line(ys: Column, h: Column | int, factors: Column, future: Column | None = None) -> Column:
    """Line over the positions and the factors; ``future`` has a row of factor values for each step, else the last row stays."""

    def roll(v: Column) -> Column:
        rows = F.transform(v, lambda _, i: F.concat(F.array(i.cast("double")), F.get(factors, i)))
        ahead = lambda k: F.element_at(factors, -1) if future is None else F.coalesce(F.get(future, k), F.element_at(factors, -1))
        return let(
            least_squares(rows, v),
            lambda f: F.transform(sm.steps(h), lambda k: F.greatest(value(f, F.concat(F.array((F.size(v) + k).cast("double")), ahead(k))), sm.zero())),
        )

    return F.when(F.size(ys) >= F.size(F.get(factors, 0)) + 3, let(ys, roll)).otherwise(sm.linear(ys, h))


# ---------------------------------------------------------------- seeded draws and the consensus trend

# Multiplier and modulus of the minimal standard generator.
MULTIPLIER, MODULUS = 48271, 2147483647


def draw(*parts: Column | int) -> Column:
    """A number from 0 to 2147483646 that depends on the parts alone, the same in any engine."""
    out = F.lit(1).cast("bigint")
    for p in parts:
        p = F.lit(p) if isinstance(p, int) else p
        out = ((out + p.cast("bigint") + 1) * MULTIPLIER) % MODULUS
    return (out * MULTIPLIER) % MODULUS


def consensus_slope(ys: Column, trials: int = 40, seed: int = 42) -> Column:
    """Slope of the line that most of the points agree on, by seeded sampling; ``ys`` is a short window.

    Each trial fits a line to half of the points (three at least), drawn by the seed, and counts the points
    within half a deviation of the last twelve values. The trial with most such points wins, the first of equal ones; the line is
    fitted again to its points. Under four points the plain line is taken.
    """

    def fit(points: Column) -> Column:
        def with_means(m: Column) -> Column:
            sxx = sm.total(F.transform(points, lambda p: (p["x"] - m["x"]) * (p["x"] - m["x"])))
            sxy = sm.total(F.transform(points, lambda p: (p["x"] - m["x"]) * (p["y"] - m["y"])))
            slope = F.coalesce(F.try_divide(sxy, sxx), sm.zero())
            return let(slope, lambda s: F.struct(s.alias("slope"), (m["y"] - s * m["x"]).alias("level")))

        means = F.struct(sm.mean(F.transform(points, lambda p: p["x"])).alias("x"), sm.mean(F.transform(points, lambda p: p["y"])).alias("y"))
        return let(means, with_means)

    def search(v: Column) -> Column:
        n = F.size(v)
        points = F.transform(v, lambda y, i: F.struct(i.cast("double").alias("x"), y.alias("y")))
        size = F.greatest(F.lit(3), F.floor(n * 0.5).cast("int"))
        room = sm.pop_std(sm.tail(v, 12)) * 0.5

        def trial(k: Column, p: Column, near: Column) -> Column:
            dealt = F.sort_array(F.transform(p, lambda q, i: F.struct(draw(seed, k, i).alias("d"), i.alias("i"), q.alias("q"))))
            chosen = F.transform(F.slice(dealt, F.lit(1), size), lambda d: d["q"])
            agreeing = lambda f: F.filter(p, lambda q: F.abs(q["y"] - f["level"] - f["slope"] * q["x"]) <= near)
            return let(let(chosen, fit), lambda f: let(agreeing(f), lambda a: F.struct((-F.size(a)).alias("few"), k.alias("k"), a.alias("points"))))

        def with_points(s: Column) -> Column:
            best = F.array_min(F.transform(indices(trials), lambda k: trial(k, s["p"], s["room"])))
            return let(best, lambda b: F.when(F.size(b["points"]) >= 2, fit(b["points"])["slope"]).otherwise(fit(s["p"])["slope"]))

        return let(F.struct(points.alias("p"), room.alias("room")), with_points)

    return F.when(F.size(ys) >= 4, let(ys, search)).otherwise(sm.line(ys)["slope"])
