"""Toxicity by a classifier chain of linear models over word and word-beginning features.

Categories are predicted one after the other; each model also sees the chances that the earlier ones
gave. In training those are out-of-fold predictions, so a later model meets earlier chances of the
quality it will meet in use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.columns import packed, stored, unpacked
from demandloom.llm.shingles import pieces

CATEGORIES = ("low_quality", "toxic")
SAMPLE, FOLDS, MIN_DOCS, MIN_CHI2, MOST_FEATURES = 12_000, 5, 3, 15.0, 2000
STEPS, RATE, RIDGE = 150, 0.2, 1e-4
WORD = re.compile(r"[^\W\d_]+")
DENSE = ("words", "word_length", "distinct", "capitals", "symbols", "marks")
CACHE = 50_000


def word_features(word: str) -> tuple[str, ...]:
    """The lower-cased word, and its beginnings of four and five letters, which inflected forms share."""
    w = word.lower()
    return (w, *(f"{w[:k]}~" for k in (4, 5) if len(w) >= k))


def dense_features(text: str, words: list[str]) -> list[float]:
    n, chars = max(1, len(words)), max(1, len(text))
    marks = sum(map(text.count, "!?"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    return [np.log1p(len(words)) / 5, sum(map(len, words)) / n / 5, len(set(words)) / n, capitals / n, 20 * symbols / chars, 20 * marks / chars]


@dataclass
class Chain:
    """Linear models in category order: weights by feature, then of dense values, of earlier chances, and a constant."""

    categories: tuple[str, ...]
    features: list[str]
    weights: np.ndarray
    dense: np.ndarray
    earlier: list[np.ndarray]
    constant: np.ndarray

    def scores(self, sums: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Chances of all categories; ``sums`` are the summed feature weights of each document."""
        out = np.zeros((len(sums), len(self.categories)))
        for c in range(len(self.categories)):
            out[:, c] = _chance(sums[:, c] + dense @ self.dense[c] + out[:, :c] @ self.earlier[c] + self.constant[c])
        return out


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_one(rows: np.ndarray, cols: np.ndarray, more: np.ndarray, y: np.ndarray, use: np.ndarray, m: int) -> np.ndarray:
    """Logistic regression by Adam on the rows in ``use``; weights of m features, the columns of ``more`` and a constant."""
    full = np.c_[more, np.ones(len(y))]
    keep = use[rows]
    rows, cols = rows[keep], cols[keep]
    n, w = max(1, int(use.sum())), np.zeros(m + full.shape[1])
    rate = np.clip(y[use].mean() if use.any() else 0.0, 1e-3, 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        error = (_chance(np.bincount(rows, w[cols], len(y)) + full @ w[m:]) - y) * use
        grad = np.r_[np.bincount(cols, error[rows], m), error @ full] / n + RIDGE * np.r_[w[:-1], 0]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def fit_chain(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, labels: np.ndarray, features: list[str], categories: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """``rows``, ``cols``: which row has which feature. ``labels``: a column of 0 and 1 per category."""
    m, n, k = len(features), len(labels), dense.shape[1]
    earlier = np.zeros((n, 0))
    parts = {"weights": [], "dense": [], "earlier": [], "constant": []}
    fold = np.arange(n) % folds
    for c in range(len(categories)):
        more, y = np.c_[dense, earlier], labels[:, c].astype(float)
        held_out = np.zeros(n)
        for f in range(folds if c + 1 < len(categories) else 0):
            w = _fit_one(rows, cols, more, y, fold != f, m)
            chance = _chance(np.bincount(rows, w[cols], n) + np.c_[more, np.ones(n)] @ w[m:])
            held_out = np.where(fold == f, chance, held_out)
        w = _fit_one(rows, cols, more, y, np.ones(n, bool), m)
        for name, part in zip(parts, (w[:m], w[m : m + k], w[m + k : -1], w[-1]), strict=True):
            parts[name].append(part)
        earlier = np.c_[earlier, held_out]
    return Chain(categories, features, np.array(parts["weights"]).T.reshape(m, len(categories)), np.array(parts["dense"]), parts["earlier"], np.array(parts["constant"]))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """The chain fitted on at most ``sample`` labelled documents, the first by hash of their id, one of each id.

    ``labels`` has doc_id and a column of 0 and 1 per category; rows with a null are no labels. Features are the words and beginnings
    found in ``MIN_DOCS`` sample documents whose chi-square for a category reaches ``MIN_CHI2``, at
    most ``MOST_FEATURES`` of each category; they are counted and chosen in Spark. Without labels, or
    with one class only, the chain gives the base rate everywhere.
    """
    ys = [F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]
    some = labels.dropna(subset=["doc_id", *categories]).orderBy(F.xxhash64("doc_id"), "doc_id", *categories).limit(sample).select(F.col("doc_id").alias("id"), *ys)
    n = len(categories)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in pieces(batch, 0)):
            for t, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = WORD.findall(t or "")
                found = sorted({f for w in set(words) for f in word_features(w)})
                yield pa.RecordBatch.from_pydict({"id": [rest[0]], "found": pa.array([found], pa.list_(pa.string())), "dense": pa.array([dense_features(t or "", words)], pa.list_(pa.float64())), "ys": pa.array([rest[1:]], pa.list_(pa.int32()))})

    # The sample is at most ``sample`` rows of a few numbers, so it may be sent to all.
    joined = docs.select(docs[text].alias("t"), docs[doc_id].alias("id")).join(F.broadcast(some), "id")
    # One document per labelled id, the least by hash of its text, so that no more than the sample go on.
    joined = joined.groupBy("id", *[f"y{i}" for i in range(n)]).agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t", "id", *[f"y{i}" for i in range(n)])
    kind = joined.schema["id"].dataType.simpleString()
    rows = stored(joined.mapInArrow(describe, f"id {kind}, found array<string>, dense array<double>, ys array<int>"))
    totals = rows.agg(F.count("*"), *[F.sum(F.col("ys")[i]) for i in range(n)]).first()
    seen = rows.select("ys", F.explode("found").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(F.col("ys")[i]).alias(f"p{i}") for i in range(n)])
    seen = stored(seen.where(F.col("n") >= MIN_DOCS))
    chosen: set[str] = set()
    for i in range(n):
        all_, pos = float(totals[0] or 0), float(totals[i + 1] or 0)
        a, b = F.col(f"p{i}").cast("double"), F.col("n").cast("double")
        spread = b * (F.lit(all_) - b) * F.lit(pos * (all_ - pos))
        chi2 = F.when(spread > 0, F.lit(all_) * F.pow(F.lit(all_) * a - b * F.lit(pos), 2) / spread).otherwise(F.lit(0.0))
        best = seen.withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "feature").limit(MOST_FEATURES)
        chosen |= {r[0] for r in best.select("feature").collect()}
    features = sorted(chosen)
    place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value
        for b in batches:
            cols = [[at[f] for f in found if f in at] for found in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols, pa.list_(pa.int32())), b.column(2), b.column(3)], ["id", "cols", "dense", "ys"])

    got = rows.mapInArrow(number, f"id {kind}, cols array<int>, dense array<double>, ys array<int>").orderBy("id", "ys", "cols", "dense").toArrow()
    cols = got["cols"].combine_chunks()
    sizes = np.diff(cols.offsets.to_numpy()) if len(got) else np.zeros(0, int)
    dense = np.array(got["dense"].to_pylist(), float).reshape(len(got), len(DENSE))
    ys = np.array(got["ys"].to_pylist(), int).reshape(len(got), n)
    return fit_chain(np.repeat(np.arange(len(got)), sizes), cols.flatten().to_numpy(zero_copy_only=False).astype(int), dense, ys, features, categories)


def score(docs: DataFrame, chain: Chain, text: str = "text", reject: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """Every document with the chance of each category as ``p_<category>`` and ``rejected``.

    Narrow: no shuffle. A null text counts as empty; repeated rows are scored alike; an empty table
    gives no rows; input columns with a computed name are replaced.
    """
    own, held = docs.columns, docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    df = packed(docs)
    place = [c.lower() for c in own].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        at, cache = {f: i for i, f in enumerate(c.features)}, {}
        for rows, texts in ((part.column(0), part.column(1)) for b in batches for part in pieces(pa.record_batch([b.column(0), b.column(0).field(place)], ["row_", "text_"]), 1)):
            sums, dense = np.zeros((len(rows), len(c.categories))), np.zeros((len(rows), len(DENSE)))
            for i, t in enumerate(t or "" for t in texts.to_pylist()):
                words = WORD.findall(t)
                found = set()
                for w in set(words):
                    hit = cache.get(w)
                    if hit is None:
                        if len(cache) > CACHE:
                            cache.clear()
                        hit = cache[w] = tuple(at[f] for f in word_features(w) if f in at)
                    if hit:
                        found.update(hit)
                if found:
                    sums[i] = c.weights[sorted(found)].sum(0)
                dense[i] = dense_features(t, words)
            scores = c.scores(sums, dense)
            yield pa.RecordBatch.from_arrays([rows, *[pa.array(scores[:, k]) for k in range(len(names))]], ["row_", *names])

    kind = df.schema["row_"].dataType.simpleString()
    scored = df.mapInArrow(run, f"row_ {kind}, " + ", ".join(f"`{x}` double" for x in names))
    return unpacked(scored, own, {x: F.col(x) for x in names} | {"rejected": F.col(f"p_{reject}") >= threshold})


def categories_of(labels: DataFrame) -> DataFrame:
    """The given labels as categories: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
