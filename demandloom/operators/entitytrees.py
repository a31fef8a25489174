"""Regression trees of every entity, grown level by level for all entities at once.

A level is one aggregate: the sums of targets and weights by entity, tree, node, feature and value make
the histograms, running sums over them score every cut, and the best cut of each node is joined back to its
rows. A forest grows all its trees side by side; boosting grows one tree after the other on what the
trees before it left. Targets are whole numbers of millionths, so sums are exact and equal cuts
tie the same way whatever the order of rows. An entity has as many rows as its calendar has periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import seriesmath as sm
from demandloom.functions.regression import draw, indices
from demandloom.operators.trees import LAGS, MIN_POINTS, within
from demandloom.session import cut_lineage

UNIT = 1_000_000.0


def _rows(series: DataFrame, keys: Sequence[str], factors: str | None) -> DataFrame:
    """(k, row, x, y, m): the lag rows of each entity long enough, and their number."""
    lags = sm.lag_rows(F.col("ys"), LAGS, F.col(factors) if factors else None)
    packed = series.where(F.size("ys") >= MIN_POINTS).select(F.struct(*keys).alias("k"), lags.alias("r"))
    return packed.select("k", F.size("r").alias("m"), F.posexplode("r").alias("row", "s")).select("k", "m", "row", "s.x", "s.y")


def grow(samples: DataFrame, depth: int, min_leaf: int, ridge: float) -> tuple[DataFrame, DataFrame]:
    """The trees of (k, tree, x, g, h) rows: (k, tree, node, feature, threshold, value), and the rows with their leaf ``node``.

    Node 1 is the root and node i has the children 2i and 2i + 1; values up to the threshold, the middle
    between two neighbours, go to the first. A cut maximises g²/(h + ridge) summed over both
    sides; equal cuts take the lower feature, then the lower threshold. A leaf's value is g/(h + ridge).
    """
    at, splits = ["k", "tree", "node"], None
    rows = samples.withColumn("node", F.lit(1).cast("bigint"))
    for level in range(depth):
        cells = rows.where(F.col("node") >= 2**level).select(*at, F.posexplode("x").alias("feature", "v"), "g", "h")
        cells = cells.groupBy(*at, "feature", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        part = Window.partitionBy(*at, "feature").orderBy("v")
        upto, whole = part.rowsBetween(Window.unboundedPreceding, 0), part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sums = cells.select(
            *at, "feature", ((F.col("v") + F.lead("v").over(part)) / 2).alias("threshold"),
            F.sum("g").over(upto).cast("double").alias("gl"), F.sum("h").over(upto).cast("double").alias("hl"),
            F.sum("g").over(whole).cast("double").alias("ga"), F.sum("h").over(whole).cast("double").alias("ha"),
        ).where((F.col("threshold").isNotNull()) & (F.col("hl") >= min_leaf) & (F.col("ha") - F.col("hl") >= min_leaf))
        gr, hr = F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")
        gain = F.col("gl") * F.col("gl") / (F.col("hl") + ridge) + gr * gr / (hr + ridge) - F.col("ga") * F.col("ga") / (F.col("ha") + ridge)
        best = sums.withColumn("gain", gain).where("gain > 0").groupBy(*at).agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("threshold")).alias("t"))).alias("b"))
        best = cut_lineage(best.select(*at, (-F.col("b.f")).alias("feature"), (-F.col("b.t")).alias("threshold")))
        splits = best if splits is None else splits.unionByName(best)
        child = 2 * F.col("node") + F.when(F.get("x", F.col("feature")) > F.col("threshold"), 1).otherwise(0)
        rows = rows.join(best, at, "left").withColumn("node", F.when(F.col("feature").isNotNull(), child).otherwise(F.col("node"))).drop("feature", "threshold")
    rows = cut_lineage(rows)
    leaves = rows.groupBy(*at).agg((F.sum("g") / (F.sum("h") + ridge) / UNIT).alias("value"))
    none = lambda t: F.lit(None).cast(t)
    leaves = leaves.select(*at, none("int").alias("feature"), none("double").alias("threshold"), "value")
    return leaves if splits is None else splits.withColumn("value", none("double")).unionByName(leaves), rows


def fit_forest(
    series: DataFrame, keys: Sequence[str], n_estimators: int = 100, max_depth: int = 10, min_samples_leaf: int = 1, seed: int = 42, factors: str | None = None,
) -> DataFrame:
    """A forest per entity: each tree learns from as many rows as there are, drawn with replacement by the seed."""
    within("n_estimators", n_estimators, 1, 500), within("max_depth", max_depth, 1, 50), within("min_samples_leaf", min_samples_leaf, 1, 10)
    rows = _rows(series, keys, factors)
    counts = F.transform(
        indices(n_estimators),
        lambda t: F.struct(t.alias("tree"), F.size(F.filter(indices(F.col("m")), lambda j: draw(seed, t, j) % F.col("m") == F.col("row"))).cast("bigint").alias("h")),
    )
    drawn = rows.withColumn("d", F.explode(counts)).where("d.h > 0")
    samples = drawn.select("k", F.col("d.tree").alias("tree"), "x", (F.round(F.col("y") * UNIT).cast("bigint") * F.col("d.h")).alias("g"), F.col("d.h").alias("h"))
    return grow(cut_lineage(samples), max_depth, min_samples_leaf, 0.0)[0]


def fit_boosting(
    series: DataFrame, keys: Sequence[str], n_estimators: int = 100, max_depth: int = 6, learning_rate: float = 0.1, ridge: float = 1.0, factors: str | None = None,
) -> DataFrame:
    """Boosted trees per entity: tree 0 is the mean as one leaf, each later one learns what is left, times ``learning_rate``."""
    within("n_estimators", n_estimators, 1, 1000), within("max_depth", max_depth, 1, 20), within("learning_rate", learning_rate, 0.01, 1.0)
    rows = _rows(series, keys, factors)
    mean = F.avg("y").over(Window.partitionBy("k").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = cut_lineage(rows.withColumn("base", F.round(mean * UNIT).cast("bigint")))
    none = lambda t: F.lit(None).cast(t)
    model = rows.groupBy("k").agg((F.max("base") / UNIT).alias("value"))
    model = model.select("k", F.lit(0).alias("tree"), F.lit(1).cast("bigint").alias("node"), none("int").alias("feature"), none("double").alias("threshold"), "value")
    left = rows.select("k", "x", (F.round(F.col("y") * UNIT).cast("bigint") - F.col("base")).alias("g"), F.lit(1).cast("bigint").alias("h"))
    for tree in range(1, n_estimators + 1):
        grown, placed = grow(left.withColumn("tree", F.lit(tree)), max_depth, 1, ridge)
        grown = cut_lineage(grown.withColumn("value", F.col("value") * learning_rate))
        given = grown.where("value IS NOT NULL").select("k", "node", "value")
        left = placed.join(given, ["k", "node"]).select("k", "x", (F.col("g") - F.round(F.col("value") * UNIT).cast("bigint")).alias("g"), "h")
        model = model.unionByName(grown)
    return model


def roll(model: DataFrame, series: DataFrame, keys: Sequence[str], horizon: Column | int, average: bool, factors: str | None = None) -> DataFrame:
    """keys and ``forecast``: the steps of every entity with its own trees, whose values are averaged or added up.

    Each step's value feeds the next one's lags; the last known factor values stay. Entities of fewer than
    ``MIN_POINTS`` points get their fitted line. The trees of an entity are one array in its row, a node at
    its number, and the steps are a fold over it.
    """
    shape = model.groupBy("k").agg((F.max("tree") + 1).alias("trees"), (2 * F.max("node")).alias("size"))
    places = shape.select("k", "trees", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("trees") * F.col("size") - 1)).alias("pos"))
    places = places.withColumns({"tree": F.expr("int(pos div size)"), "node": F.col("pos") % F.col("size")})
    cell = F.struct("pos", F.col("feature").alias("f"), F.col("threshold").alias("t"), F.col("value").alias("v"))
    nodes = places.join(model, ["k", "tree", "node"], "left").groupBy("k").agg(F.sort_array(F.collect_list(cell)).alias("nodes"), F.max("trees").alias("trees"), F.max("size").alias("size"))
    own = series.withColumn("k", F.struct(*keys)).withColumn("h_", horizon if isinstance(horizon, Column) else F.lit(horizon))
    long = own.where(F.size("ys") >= MIN_POINTS).join(nodes, "k")
    cut = indices(F.ceil(F.log2(F.col("size"))))

    def tree_value(x: Column, t: Column) -> Column:
        at = lambda n: F.get("nodes", (t * F.col("size") + n).cast("int"))

        def down(n: Column, _: Column) -> Column:
            return sm.let(at(n), lambda c: F.when(c["f"].isNull(), n).otherwise(2 * n + F.when(F.get(x, c["f"]) > c["t"], 1).otherwise(0)))

        return at(F.aggregate(cut, F.lit(1).cast("bigint"), down))["v"]

    def step(a: Column, j: Column) -> Column:
        x = F.concat(a["win"], F.array((F.size("ys") + j).cast("double")))
        if factors is not None:
            x = F.concat(x, F.element_at(factors, -1))
        made = sm.let(x, lambda q: sm.total(F.transform(indices(F.col("trees")), lambda t: tree_value(q, t))))
        made = made / F.col("trees") if average else made
        return sm.let(
            F.greatest(made, sm.zero()),
            lambda y: F.struct(F.concat(F.slice(a["win"], 2, LAGS), F.array(y)).alias("win"), F.concat(a["out"], F.array(y)).alias("out")),
        )

    start = F.struct(sm.tail(F.col("ys"), LAGS).alias("win"), F.array().cast("array<double>").alias("out"))
    trees = long.select(*keys, F.aggregate(sm.steps(F.col("h_")), start, step, lambda a: a["out"]).alias("forecast"))
    return trees.unionByName(own.where(F.size("ys") < MIN_POINTS).select(*keys, sm.linear(F.col("ys"), F.col("h_")).alias("forecast")))


def forest_forecast(series: DataFrame, keys: Sequence[str], horizon: Column | int, factors: str | None = None, **options) -> DataFrame:
    return roll(fit_forest(series, keys, factors=factors, **options), series, keys, horizon, True, factors)


def boosting_forecast(series: DataFrame, keys: Sequence[str], horizon: Column | int, factors: str | None = None, **options) -> DataFrame:
    return roll(fit_boosting(series, keys, factors=factors, **options), series, keys, horizon, False, factors)
