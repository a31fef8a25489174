"""URL verdicts: listed rules first, boosted trees over lexical features for the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.columns import ascii_lower, let, packed, unpacked
from demandloom.session import cut_lineage

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SAMPLE, ROUNDS, DEPTH, SMOOTH, SEED, FOLDS = 20_000, 12, 4, 10.0, 7, 5
SUFFIXES = {"suffix": 1, "suffix2": 2, "suffix3": 3}  # host suffixes by their number of labels
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "longest_digits", "parameters", "hyphens",
    "escapes", "capitals", "entropy", "has_fragment", "ends_in_slash", *[f"{s}_rate" for s in SUFFIXES],
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host, subdomains and paths it begins."""
    text, verdict = [], []
    for say, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, tail = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + tail))
        text.append(F.when(fits, F.lit(rule)))
        verdict.append(F.when(fits, F.lit(say)))
    none = F.lit(None).cast("string")
    return F.coalesce(*text, none), F.coalesce(*verdict, none)


def entropy(text: Column) -> Column:
    """Bits per character, from the lengths of the runs of equal characters in sorted order."""
    chars = F.sort_array(F.array_remove(F.split(text, ""), ""))

    def bits(cs: Column) -> Column:
        n = F.size(cs).cast("double")
        ends = F.filter(F.sequence(F.lit(1), F.size(cs)), lambda i: (i == F.size(cs)) | (F.get(cs, i) != F.get(cs, i - 1)))
        share = lambda es, i, e: (e - F.when(i == 0, 0).otherwise(F.get(es, i - 1))) / n
        parts = let(ends, lambda es: F.transform(es, lambda e, i: let(share(es, i, e), lambda p: -p * F.log2(p))))
        return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)).otherwise(0.0)

    return let(chars, bits)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    n = F.char_length(url)
    left = lambda c, pattern: F.char_length(F.regexp_replace(c, pattern, "")).cast("double")
    digits = left(url, "[^0-9]+")
    return {
        "url_length": n.cast("double"), "host_length": F.char_length(host).cast("double"), "path_length": F.char_length(path).cast("double"),
        "depth": left(path, "[^/]+"), "labels": left(host, "[^.]+"), "digits": digits, "digit_ratio": digits / F.greatest(n, F.lit(1)),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.split(url, "[^0-9]+"), F.char_length)), F.lit(0)).cast("double"),
        "parameters": left(url, "[^=]+"), "hyphens": left(url, "[^-]+"), "escapes": left(url, "[^%]+"), "capitals": left(url, "[^A-Z]+"),
        "entropy": entropy(url), "has_fragment": F.contains(url, F.lit("#")).cast("double"), "ends_in_slash": F.endswith(url, F.lit("/")).cast("double"),
    }


def _rated(df: DataFrame, labelled: DataFrame, apart: bool) -> DataFrame:
    """Block rates of the host's suffixes, counted over all labelled URLs.

    A longer suffix starts from the rate of the shorter one, the shortest from that of all URLs, so an
    unseen one adds nothing. With ``apart`` a row's own part of the hosts is left out of its rates: a
    labelled URL meets rates that neither it nor another URL of its host went into, as a new host does.
    """
    counts = [F.count("*").alias("n_"), F.sum("label").alias("b_")]
    folds = {r["fold"]: (r["n_"], r["b_"]) for r in labelled.groupBy("fold").agg(*counts).collect()}
    n, b = (sum(x[i] for x in folds.values()) for i in (0, 1))
    share = lambda blocked, all_: float(blocked + 1) / (all_ + 2)
    rate = F.lit(share(b, n))
    if apart:
        for fold, (n_own, b_own) in folds.items():
            rate = F.when(F.col("fold") == fold, share(b - b_own, n - n_own)).otherwise(rate)
    for key in SUFFIXES:
        df = df.join(labelled.groupBy(key).agg(*counts), key, "left")
        n, b = F.col("n_"), F.col("b_")
        if apart:
            own = labelled.groupBy(key, "fold").agg(F.count("*").alias("n_own"), F.sum("label").alias("b_own"))
            df = df.join(own, [key, "fold"], "left")
            n, b = n - F.col("n_own"), b - F.col("b_own")
        df = df.withColumn(f"{key}_rate", (F.coalesce(b, F.lit(0.0)) + SMOOTH * rate) / (F.coalesce(n, F.lit(0)) + SMOOTH)).drop("n_", "b_", "n_own", "b_own")
        rate = F.col(f"{key}_rate")
    return df


def _labelled(seen: DataFrame, labels: DataFrame | None, rules) -> DataFrame:
    if labels is None:
        rows = seen.where("rule_ IS NOT NULL").withColumn("label", (F.col("said_") == "block").cast("double"))
    else:
        rows = _described(labels.select(F.coalesce(F.col("url"), F.lit("")).alias("url_"), F.col("label").cast("double").alias("label")), rules)
    fold = F.pmod(F.xxhash64("host_"), F.lit(FOLDS)).alias("fold")
    return cut_lineage(rows.select("url_", "host_", "label", fold, *SUFFIXES, *[c for c in FEATURES if c in rows.columns]))


def _learned(labelled: DataFrame, sample: int) -> tuple[Callable[[DataFrame], DataFrame], float] | tuple[None, float]:
    """What adds ``score_`` to described URLs, and the least score to block; None where only one verdict is labelled."""
    kinds = [r[0] for r in labelled.select("label").distinct().collect()]
    if len(kinds) < 2:
        return None, kinds[0] if kinds else 0.0
    model = _fit(labelled, sample)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features_")
    return lambda df: model.transform(assembler.transform(_rated(df, labelled, False))).withColumn("score_", vector_to_array("probability")[1]), 0.5


def held_out(pages: DataFrame, url: str = "url", rules=RULES, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Rows (label, verdict, n) over the labelled URLs of a fifth of the hosts, by trees that met none of these hosts."""
    seen = _described(pages.select(F.coalesce(pages[url], F.lit("")).alias("url_")), rules)
    labelled = _labelled(seen, labels, rules)
    score, least = _learned(labelled.where("fold > 0"), sample)
    test = labelled.where("fold = 0")
    said = F.lit(least) if score is None else (F.col("score_") >= least).cast("double")
    scored = (test if score is None else score(test)).withColumn("said", F.when(said > 0, "block").otherwise("allow"))
    return scored.groupBy("label", F.col("said").alias("verdict")).agg(F.count("*").alias("n"))


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule``, ``score`` (chance of block) and ``verdict``.

    The rule's verdict holds where one fits. Other URLs get the trees' verdict, which are fitted on at
    most ``sample`` labelled URLs, the first by hash: those in ``labels`` (url, label 1 for block), or
    else the URLs the rules decide. Block rates of host suffixes (one to three labels) are counted over
    all labelled URLs; those the trees are fitted with leave out the URL's own fifth of the hosts.
    Where only one verdict, or none, is labelled, the rest gets that verdict, or allow. A null or
    malformed URL has an empty host and path, fits no rule and is judged like any other; repeated rows
    are judged alike; an empty table gives no rows; input columns with a computed name are replaced.
    """
    own = pages.columns
    df = packed(pages).withColumn("url_", F.coalesce(F.col("row_").getField(url), F.lit("")))
    seen = _described(df.select("row_", "url_"), rules)
    score, least = _learned(_labelled(seen, labels, rules), sample)
    scored = seen.withColumn("score_", F.lit(least)) if score is None else score(seen)
    verdict = F.when(F.col("score_") >= 0.5, "block").otherwise("allow")
    return unpacked(scored, own, {"host": F.col("host_"), "path": F.col("path_"), "rule": F.col("rule_"), "score": F.col("score_"), "verdict": F.coalesce("said_", verdict)})


def _described(df: DataFrame, rules) -> DataFrame:
    host, path = host_and_path(F.col("url_"))
    df = df.withColumns({"host_": host, "path_": path})
    rule, said = rule_columns(F.col("host_"), F.col("path_"), rules)
    suffixes = {key: F.substring_index("host_", ".", -n) for key, n in SUFFIXES.items()}
    return df.withColumns({"rule_": rule, "said_": said} | suffixes | lexical(F.col("url_"), F.col("host_"), F.col("path_")))


def _fit(labelled: DataFrame, sample: int):
    """Boosted trees on the first ``sample`` labelled URLs by hash, in one order and one partition: the same on every run."""
    order = [F.xxhash64("url_"), F.col("url_")]
    some = labelled.orderBy(*order).limit(sample)
    some = _rated(cut_lineage(some), labelled, True).coalesce(1).sortWithinPartitions(*order)
    some = VectorAssembler(inputCols=FEATURES, outputCol="features_").transform(some).select("features_", "label")
    trees = GBTClassifier(featuresCol="features_", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED)
    return trees.fit(cut_lineage(some))
