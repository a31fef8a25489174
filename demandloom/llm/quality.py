"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.columns import every, let, packed, unpacked, words

STOP_WORDS = {
    "en": "the of and to in is that it for was on with as at by be this from",
    "de": "der die das und ist von zu den mit für im ein nicht auf als auch",
    "fr": "de la le les et des en un une est que pour dans qui sur au par",
    "es": "de la que el en y los del se las por un para con no una su",
}


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [least, most]; judged only from ``words`` words on."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    words: int = 0


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("shouting", "marks_per_word", None, 0.3),
    Rule("stop_words", "stop_word_share", 0.03, None, 30),
    Rule("repeated_lines", "dup_line_share", None, 0.5),
    Rule("ellipses", "ellipsis_line_share", None, 0.3, 30),
)
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20


def repeated_words(tokens: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``window`` words that the text holds twice or more, the first included.

    Windows are compared by 64-bit hashes. Only a text that repeats one sorts its windows, so no
    text costs more than a sort of its words.
    """
    at = lambda h, i: F.xxhash64(*[h[i + k] for k in range(window)])
    starts = lambda h: F.slice(h, 1, F.greatest(F.size(h) - (window - 1), F.lit(0)))
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(starts(h), lambda _, i: at(h, i)))
    same = lambda s, k, d: F.get(s, k + d)["h"] == F.get(s, k)["h"]

    def covered(hs: Column) -> Column:
        order = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(order, lambda s: F.filter(s, lambda _, k: F.coalesce(same(s, k, -1), F.lit(False)) | F.coalesce(same(s, k, 1), F.lit(False))))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        step = lambda p, x, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(p, k - 1)))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: step(p, x, k)), F.lit(0), lambda a, x: a + x))

    return let(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs))).cast("long")


def measures(text: Column, tokens: Column) -> dict[str, Column]:
    """Counts of one text; ``tokens`` are its words."""
    text = F.coalesce(text, F.lit(""))
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.char_length(F.array_join(tokens, "")).cast("long"),
        "n_symbols": left("[^#*$%&|<>]+"),
        "n_marks": left("[^!?]+"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[ \\x09-\\x0D]*$"))).cast("long"),
        "n_stop_words": F.size(F.filter(tokens, lambda w: F.lower(w).isin(stop))).cast("long"),
        "n_repeat_words": repeated_words(tokens),
    }


def ratios() -> dict[str, Column]:
    """Ratios of the counts; of an empty text all are 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "stop_word_share": share("n_stop_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "ellipsis_line_share": share("n_ellipsis_lines", "n_lines"),
    }


def passes(rule: Rule) -> Column:
    bounds = [F.col(rule.metric) >= rule.least] * (rule.least is not None) + [F.col(rule.metric) <= rule.most] * (rule.most is not None)
    return (F.col("n_words") < rule.words) | every(bounds)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document with its counts, ratios, the rules it breaks and the verdict.

    Narrow: no shuffle, no user function. A null text counts as empty and fails the word count; an
    empty table gives no rows; repeated rows are judged alike, each by itself; an input column with a
    computed name is replaced. Base failure: fewer than ``MIN_WORDS`` words, or more than
    ``MAX_REPEAT_PERCENT`` percent of them inside repeated windows.
    """
    own = docs.columns
    df = packed(docs).withColumn("tokens_", words(F.col("row_").getField(text)))
    counts = measures(F.col("row_").getField(text), F.col("tokens_"))
    df = df.select("row_", *[v.alias(k) for k, v in counts.items()])
    df = df.select("*", *[v.alias(k) for k, v in ratios().items()])
    base = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    out = {c: F.col(c) for c in (*counts, *ratios())}
    out["base_failed"] = base
    out["broken_rules"] = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]))
    out["kept"] = ~base & every([passes(r) for r in rules])
    return unpacked(df, own, out)
