"""Personal data: exact patterns, and boosted trees over what wider generators propose."""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.columns import let, placed, stored, unpacked
from demandloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# The base patterns; possessive where nothing after could match what was taken, so long runs cost no stack.
# A match can begin only where a run begins or the last match ended: every other start would fail alike.
BASE = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
# Wider proposals, which overlap one another and the base spans.
WIDE = {
    "email": "[A-Za-z0-9._%+-]++ ?(?:@|\\(at\\)|\\[at\\]) ?[A-Za-z0-9-]++(?: ?(?:\\.|\\(dot\\)|\\[dot\\]) ?[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": "(?<![0-9])[0-9]{4}(?:[ ._/-]?[0-9]{4}){2,3}(?![0-9])",
    "phone": "(?<![0-9.])[(]?[0-9]{2,4}[)]?[ ./-][0-9]{2,4}[ ./-][0-9]{2,5}(?:[ ./-][0-9]{2,5})?(?![0-9.])",
    "token": "[^ \\x09-\\x0D]*[0-9]{3}[^ \\x09-\\x0D]*+",
}
OPEN, CLOSE, PLAIN = "\x01", "\x02", "\x03"
BLOCK = 256  # parts; even, as every second part is a match
PLANTS, ROUNDS, DEPTH, PRECISION, SEED, CONTEXT = 4, 10, 4, 0.99, 11, 24
LARGEST, STEPS = 63, 32  # features: counts above, and parts of a share below, are alike
FORMAT = ["length", "digits", "groups", "longest_group", "letters", "dots", "colons", "ats", "hyphens", "spaces", "brackets", "hex_share", "distinct", "check_sum"]
NEAR = ["glued_left", "glued_right", "quote_left", "equals_left", "cue_phone", "cue_card", "cue_mail", "cue_net", "cue_secret"]
CUES = {
    "cue_phone": "(?i)\\b(tel|phone|call|fax|mobile|tél|telefon|llame)", "cue_card": "(?i)\\b(card|visa|iban|karte|carte|tarjeta|pay)",
    "cue_mail": "(?i)\\b(mail|contact|write|correo|courriel)", "cue_net": "(?i)\\b(ip|host|server|addr|ping)", "cue_secret": "(?i)(token|password|key|secret|sha|hash|id)",
}


def spans(text: Column, pattern: str, kind: str) -> Column:
    """(kind, start, end, value, left, right) of the leftmost matches that do not overlap, in code points.

    Places are running sums of the parts' lengths, taken in blocks of parts: an array that grows by one
    element a match is copied each time, so a block keeps the work per match constant in long texts.
    """
    marked = F.regexp_replace(text, f"({pattern})", f"{OPEN}$1{CLOSE}")
    parts = F.split(marked, f"[{OPEN}{CLOSE}]")
    near = lambda p, i, side: F.when(F.lit(side < 0), F.substring(F.get(p, i - 1), -CONTEXT, CONTEXT)).otherwise(F.substring(F.get(p, i + 1), 1, CONTEXT))
    long = lambda x: F.lit(x).cast("long")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,i:int>>)")

    def walk(i0: Column):
        def step(a: Column, x: Column) -> Column:
            end = a["at"] + F.char_length(x)
            one = F.array(F.struct(a["at"].alias("start"), end.alias("end"), (i0 + a["i"]).alias("i")))
            return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), F.when(a["i"] % 2 == 1, F.concat(a["found"], one)).otherwise(a["found"]).alias("found"))

        return step

    def all_(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        part = lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK))
        lengths = F.transform(blocks, lambda b: F.aggregate(part(b), long(0), lambda n, x: n + F.char_length(x)))
        begin = F.struct(long(0).alias("at"), F.expr("cast(array() as array<bigint>)").alias("all"))
        before = F.aggregate(lengths, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
        start = lambda at: F.struct(at.alias("at"), F.lit(0).alias("i"), none.alias("found"))
        many = F.flatten(F.transform(before, lambda at, b: F.aggregate(part(b), start(at), walk(b * BLOCK))["found"]))
        found = F.when(F.size(p) > BLOCK, many).otherwise(F.aggregate(p, start(long(0)), walk(F.lit(0)))["found"])
        return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), p[s["i"]].alias("value"), near(p, s["i"], -1).alias("left"), near(p, s["i"], 1).alias("right")))

    return let(parts, all_)


def check_digit(digits: Column) -> Column:
    """Last digit of the digits' check sum, every second one from the right doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9"))).otherwise(F.try_to_number(d, F.lit("9")) * 2).cast("int"))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10


def luhn(digits: Column) -> Column:
    """Whether the digits' check sum ends in 0."""
    return check_digit(digits) == 0


def valid(kind: Column, value: Column) -> Column:
    """The check of each base kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    parts = F.transform(F.split(value, "\\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    card = F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", small).when(kind == "card", card).otherwise(n.between(9, 15))


def proposed(text: Column, patterns: dict[str, str]) -> Column:
    """Spans of all patterns; one whose signs (``@``, ``.``, ``+``, ``:``) the text lacks is not tried."""
    has = lambda c: F.contains(text, F.lit(c))
    needs = {BASE["email"]: has("@"), WIDE["email"]: has("@") | text.rlike("[(\\[]at[)\\]]"), BASE["ip"]: has("."), WIDE["ip"]: has(":"), BASE["phone"]: has("+")}
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:string,left:string,right:string>>)")
    return F.concat(*[F.when(needs.get(p, text.rlike("[0-9]")), spans(text, p, k)).otherwise(none) for k, p in patterns.items()])


def candidates(docs: DataFrame) -> DataFrame:
    """A row per proposed span of documents (at, text): base matches that pass their check have ``base``."""
    clean = F.translate(F.coalesce(docs["text"], F.lit("")), OPEN + CLOSE, PLAIN + PLAIN)
    rows = docs.select("at", clean.alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9]") | F.contains("text", F.lit("@")) | F.col("text").rlike("[(\\[]at[)\\]]"))
    base = rows.select("at", F.lit(True).alias("exact"), F.explode(proposed(F.col("text"), BASE)).alias("s"))
    wide = rows.select("at", F.lit(False).alias("exact"), F.explode(proposed(F.col("text"), WIDE)).alias("s"))
    df = base.unionByName(wide).select("at", "exact", "s.*")
    return df.withColumn("base", F.col("exact") & valid(F.col("kind"), F.col("value")))


def described(df: DataFrame) -> DataFrame:
    """Format features of the value and of what stands around it: counts up to ``LARGEST``, shares in steps of 1 / ``STEPS``, flags."""
    value, left, right = F.col("value"), F.col("left"), F.col("right")
    n = F.greatest(F.char_length(value), F.lit(1)).cast("double")
    count = lambda c: F.least(c, F.lit(LARGEST)).cast("double")
    share = lambda c: F.floor(c * STEPS) / F.lit(float(STEPS))
    left_only = lambda pattern: F.char_length(F.regexp_replace(value, pattern, ""))
    held = lambda *chars: count(F.char_length(value) - F.char_length(F.translate(value, "".join(chars), "")))
    groups = F.filter(F.split(value, "[^0-9]+"), lambda x: x != "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = {
        "length": count(n), "digits": count(left_only("[^0-9]+")), "groups": count(F.size(groups)),
        "longest_group": count(F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0))), "letters": count(left_only("[^A-Za-z]+")),
        "dots": held("."), "colons": held(":"), "ats": held("@"), "hyphens": held("-"), "spaces": held(" "),
        "brackets": held("(", ")", "[", "]"), "hex_share": share(left_only("[^0-9A-Fa-f]+") / n), "distinct": share(F.size(F.array_distinct(F.split(value, ""))) / n),
        "check_sum": flag(luhn(F.regexp_replace(value, "[^0-9]", ""))),
        "glued_left": flag(left.rlike("[\\p{L}\\p{N}]$")), "glued_right": flag(right.rlike("^[\\p{L}\\p{N}]")), "quote_left": flag(left.rlike("[\"'`]$")), "equals_left": flag(left.rlike("[=:] ?[\"']?$")),
    }
    return df.withColumns(out | {c: flag(left.rlike(p)) for c, p in CUES.items()})


def forms(seed: Column) -> list[tuple[str, int, Column, Column]]:
    """(kind, label, words before, value) of what is planted, from 32 hex digits: data in unlisted formats, and what only looks like it."""
    part = lambda a, n: F.substring(F.translate(seed, "abcdef", "012345"), a, n)
    join_ = lambda sep, *xs: F.concat_ws(sep, *[F.lit(x) if isinstance(x, str) else x for x in xs])
    last = ((10 - check_digit(F.concat(part(1, 15), F.lit("0")))) % 10).cast("string")
    good, bad = F.concat(part(13, 3), last), F.concat(part(13, 3), F.when(last == "0", "1").otherwise("0"))
    fours = lambda sep, end: let(end, lambda x: join_(sep, part(1, 4), part(5, 4), part(9, 4), x))
    wide = join_(":", *[F.substring(seed, i, 4) for i in range(1, 32, 4)])
    return [
        (kind, label, F.lit(cue), value) for kind, label, cue, value in (
            ("email", 1, "write to ", join_("", "u", part(1, 4), " (at) mail", part(5, 1), ".example.org")),
            ("email", 1, "", join_("", "user.", part(1, 3), "[at]site", part(4, 2), " [dot] net")),
            ("ip", 1, "host ", wide), ("ip", 1, "", wide),
            ("card", 1, "card ", fours(".", good)), ("card", 1, "", fours("/", good)),
            ("phone", 1, "tel ", join_("", "(", part(1, 3), ") ", part(4, 3), "-", part(7, 4))),
            ("phone", 1, "call ", join_(".", part(1, 3), part(4, 3), part(7, 4))), ("phone", 1, "", join_("", "(", part(1, 3), ") ", part(4, 3), " ", part(7, 4))),
            ("card", 0, "", fours(".", bad)), ("card", 0, "no ", fours("/", bad)), ("ip", 0, "at ", join_(":", part(1, 2), part(3, 2), part(5, 2), part(7, 2))),
            ("phone", 0, "", join_("", "20", part(1, 2), "-0", part(3, 1), "-1", part(4, 1))), ("phone", 0, "page ", join_("/", part(1, 2), part(3, 2), part(5, 2))),
            ("token", 0, "token = ", seed), ("token", 0, "build ", join_("", "v", part(1, 4), "abc", part(5, 3))),
        )
    ]


def planted(rows: DataFrame, each: int = PLANTS) -> DataFrame:
    """(at, held, kind, label, start, end, text): ``each`` forms within words of each document that has a letter.

    Forms are dealt by hash, so that all are equally frequent; from as many on as there are, every document has every form.
    Numbers are negative, so they meet none of the corpus; ``held`` marks those of a quarter of the documents.
    """
    at = F.pmod(F.xxhash64("text"), F.char_length("text").cast("long")).cast("int")
    near = lambda shift: F.regexp_replace(F.substr(F.col("text"), at + 1 + shift, F.lit(CONTEXT)), "[^\\p{L}]", " ")
    some = rows.where(F.col("text").rlike("\\p{L}")).select("at", F.md5(F.concat_ws(":", F.col("at").cast("string"), F.col("text"))).alias("seed"), near(0).alias("before"), near(CONTEXT).alias("after"))
    all_ = forms(F.col("seed"))
    values = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(k).alias("kind"), F.lit(float(y)).alias("label"), c.alias("cue"), v.alias("value")) for i, (k, y, c, v) in enumerate(all_)]
    first, n = F.pmod(F.xxhash64("at", F.lit("form")), F.lit(len(values))), len(values)
    dealt = lambda j: reduce(lambda c, i: c.when(F.col("form") == (i - j) % n, values[i]), range(1, n), F.when(F.col("form") == -j % n, values[0]))
    some = some.withColumn("form", first).withColumn("x", F.explode(F.array(*(values if each >= n else map(dealt, range(each))))))
    left, right = F.concat("before", F.lit(" "), "x.cue"), F.concat(F.lit(" "), "after")
    out = some.select("*", _held()).select((-F.col("at") * len(all_) - F.col("x.i") - 1).alias("at"), "held", "x.kind", "x.label", left.alias("l"), "x.value", right.alias("r"))
    start = F.char_length("l").cast("long")
    return out.select("at", "held", "kind", "label", start.alias("start"), (start + F.char_length("value")).alias("end"), F.concat("l", "value", "r").alias("text"))


def _held() -> Column:
    """Whether a document's examples are held out."""
    return (F.pmod(F.xxhash64("at", F.lit("held")), F.lit(4)) == 0).alias("held")


def _meets(a: str, b: str) -> Column:
    return (F.col(f"{a}.at") == F.col(f"{b}.at")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def examples(found: DataFrame, plants: DataFrame) -> DataFrame:
    """(features..., label, held, n): how often each feature vector occurs among all examples of the corpus.

    Examples have labels of their own: base matches by their check, wide card numbers by their check
    sum where it fails, and proposals on planted spans (a planted value itself, or what meets a planted
    look-alike). All other proposals have no label.
    """
    base = found.where("base")
    failed = found.alias("f").where("NOT base AND (exact OR kind = 'card')").where(~luhn(F.regexp_replace("value", "[^0-9]", "")) | (F.col("kind") != "card"))
    failed = failed.join(base.alias("b"), _meets("f", "b"), "left_anti")
    own = base.withColumn("label", F.lit(1.0)).unionByName(failed.withColumn("label", F.lit(0.0))).withColumn("held", _held())
    # Proposals of one planted text are gathered in its row, so no plant is shuffled.
    all_ = F.array_distinct(F.concat(proposed(F.col("text"), BASE), proposed(F.col("text"), WIDE)))
    meets = lambda x: (x["start"] < F.col("end")) & (F.col("start") < x["end"])
    whole = lambda x: (x["start"] == F.col("start")) & (x["end"] == F.col("end")) & (x["kind"] == F.col("kind"))
    hits = plants.select("label", "held", F.explode(F.filter(all_, lambda x: meets(x) & (whole(x) | (F.col("label") == 0)))).alias("s"))
    columns = ["kind", "value", "left", "right", "label", "held"]
    own = own.select("at", "start", "end", *columns).distinct().select(*columns)
    return described(hits.select("s.*", "label", "held").select(*columns).unionByName(own)).groupBy(*FORMAT, *NEAR, "label", "held").agg(F.count("*").alias("n"))


def _learn(found: DataFrame, plants: DataFrame, precision: float):
    """The trees as a function that adds ``score``, and the threshold of the asked precision; None if nothing can be learned.

    All examples are learned from, each distinct feature vector weighed by its count: features have few
    values, so these are few rows in one order, and a fit can be repeated. The threshold is the
    least whole percent at which the held-out examples, those of other documents, keep the precision.
    """
    assembler = VectorAssembler(inputCols=[*FORMAT, *NEAR], outputCol="features_")
    some = assembler.transform(examples(found, plants).withColumn("n", F.col("n").cast("double")))
    some = cut_lineage(some.coalesce(1).sortWithinPartitions(*FORMAT, *NEAR, "label", "held").select("features_", "label", "held", "n"))
    known = some.where("NOT held").groupBy("label").agg(F.count("*").alias("rows")).collect()
    if len(known) < 2:
        return None
    # With this many bins MLlib looks for splits in all rows and no sample of them.
    bins = max(LARGEST + 1, isqrt(sum(r["rows"] for r in known)) + 1)
    model = GBTClassifier(featuresCol="features_", labelCol="label", weightCol="n", maxIter=ROUNDS, maxDepth=DEPTH, maxBins=bins, seed=SEED).fit(some.where("NOT held").select("features_", "label", "n"))
    score = vector_to_array("probability")[1]
    steps = model.transform(some.where("held")).groupBy(F.floor(score * 100).alias("score")).agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("hits"))
    right = total = 0.0
    threshold = None
    for r in sorted(steps.collect(), key=lambda r: -r["score"]):
        right, total = right + r["hits"], total + r["n"]
        if right < precision * total:
            break
        threshold = r["score"] / 100
    if threshold is None:
        return None
    return lambda df: model.transform(assembler.transform(described(df))).withColumn("score", score), threshold


def _kind() -> Column:
    """The kind of a proposal; a token has that of its format, or none."""
    digits = F.col("digits")
    token = F.when(F.col("ats") > 0, "email").when((F.col("dots") == 3) & (F.col("letters") == 0), "ip").when(digits.between(13, 19) & (F.col("letters") == 0), "card").when(digits.between(9, 12) & (F.col("letters") == 0), "phone")
    return F.when(F.col("kind") != "token", F.col("kind")).otherwise(token)


def _extra(found: DataFrame, plants: DataFrame, precision: float) -> DataFrame | None:
    """Proposals beyond the base spans that the trees take, none of which overlap; None if nothing can be learned."""
    learned = _learn(found, plants, precision)
    if learned is None:
        return None
    score, threshold = learned
    free = found.alias("f").where("NOT base AND NOT exact").join(found.where("base").alias("b"), _meets("f", "b"), "left_anti")
    taken = score(free).where(F.col("score") >= threshold).select("at", _kind().alias("kind"), "start", "end").where("kind IS NOT NULL")
    return disjoint(taken)


def held_out(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """(kind, label, n, taken): planted spans of the held-out documents, and how many the operator takes or, of look-alikes, touches."""
    rows = stored(placed(docs).select("at", F.col("row_").getField(text).alias("text")))
    test = stored(planted(rows, len(forms(F.lit("")))).where("held"))
    learned = _learn(stored(candidates(rows)), planted(rows), precision)
    if learned is None:
        return test.groupBy("kind", "label").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("taken"))
    score, threshold = learned
    taken = disjoint(score(candidates(test.select("at", "text")).where("NOT exact")).where(F.col("score") >= threshold).select("at", _kind().alias("kind"), "start", "end").where("kind IS NOT NULL"))
    same = (F.col("p.label") == 0) | ((F.col("t.start") == F.col("p.start")) & (F.col("t.end") == F.col("p.end")) & (F.col("t.kind") == F.col("p.kind")))
    met = test.alias("p").join(taken.alias("t"), _meets("p", "t") & same, "left_semi").groupBy("kind", "label").agg(F.count("*").alias("taken"))
    return test.groupBy("kind", "label").agg(F.count("*").alias("n")).join(met, ["kind", "label"], "left").fillna(0, ["taken"])


def disjoint(taken: DataFrame) -> DataFrame:
    """Per document, in order of place and the longest first, each span that begins where the last kept one ended or later.

    A span that was dropped drops no other. Spans are first parted into chains of overlaps, which are
    short, as spans are; only within a chain are they taken one after the other.
    """
    order = Window.partitionBy("at").orderBy("start", F.desc("end"), "kind")
    begins = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    parted = taken.withColumn("begins", begins.cast("int")).withColumn("chain", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("start", (-F.col("end")).alias("back"), "kind", "end")
    sets = parted.groupBy("at", "chain").agg(F.sort_array(F.collect_list(span)).alias("s"))
    keep = lambda kept, x: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"] <= x["start"], F.lit(True)), F.concat(kept, F.array(x))).otherwise(kept)
    return sets.select("at", F.explode(F.aggregate("s", F.slice("s", 1, 0), keep)).alias("x")).select("at", "x.kind", "x.start", "x.end")


def find(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """Every document with ``base`` and ``spans``, arrays of (kind, start, end) by kind and start, end exclusive.

    ``base`` are the spans of the exact patterns that pass their checks; ``spans`` adds what the trees
    take. The trees and their threshold are learned from all checked proposals and from spans
    planted into words of each document; every other proposal is scored. A null or empty text
    has no spans; repeated rows get the same spans; an empty table gives no rows; input columns with a
    computed name are replaced. Rows are numbered once and stored with their number.
    """
    numbered = placed(docs)
    rows = numbered.select("at", F.col("row_").getField(text).alias("text"))
    found, plants = stored(candidates(rows)), planted(rows)
    base = found.where("base").select("at", "kind", "start", "end", F.lit(True).alias("base"))
    extra = _extra(found, plants, precision)
    if extra is not None:
        base = base.unionByName(extra.withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct(rank.alias("rank"), "start", "end", "kind", "base")
    sets = base.groupBy("at").agg(F.sort_array(F.collect_list(span)).alias("s"))
    clean = lambda s: F.transform(s, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    whole = numbered.join(sets, "at", "left")
    all_ = F.coalesce("s", F.expr("cast(array() as array<struct<rank:bigint,start:bigint,end:bigint,kind:string,base:boolean>>)"))
    return unpacked(whole, docs.columns, {"base": clean(F.filter(all_, lambda x: x["base"])), "spans": clean(all_)})


def joined(spans_: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans_: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    order = F.sort_array(F.transform(spans_, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    gap = lambda a, x: F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
    step = lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], gap(a, x), F.lit("["), x["kind"], F.lit("]")).alias("out")))
    return F.aggregate(order, start, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
