"""Benchmark decontamination by template: placeholders for numbers, names and units, hash-joined windows, slot check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.columns import join_null_safe, let, placed, unpacked
from demandloom.session import cut_lineage

WINDOW, COVERAGE, LITERALS, SENT_ROWS = 5, 0.8, 3, 500_000
LEAST_TOKENS, LEAST_BITS, MOST_BITS, SENT_BYTES = 2, 1 << 12, 1 << 24, 64 << 20
BLOCK = 128
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal ms s sec min h hr hrs day days week weeks month months year years "
    "hour hours minute minutes second seconds meter meters metre metres mile miles foot feet inch inches gram grams liter liters "
    "litre litres dollar dollars cent cents euro euros pound pounds percent degrees kmh mph"
).split()
#: Words that are no names although they begin a sentence. Words that are given names too (will, may) are left out.
FUNCTION = (
    "a about after again all also although always among an and another any are as at be because been before being both but by can cannot could "
    "did do does during each either else even every few first for from further had has have having he her here hers his how however i if in into is it its "
    "just last later let many more most much must my neither never next no nor not now of often on once one only or other our out over per "
    "shall she should since so some such than that the their them then there therefore these they this those though through thus to too two under until up upon us "
    "very was we were what whatever when whenever where whereas which while who whoever whom whose why with within without would yes yet you your "
    "aber alle als also am an auch auf aus bei beim bis da dabei dann das dass dein dem den denn der deren des dessen die dies diese dieser dieses doch du durch ein eine einem einen einer eines er es euch für "
    "gegen hat ich ihm ihn ihr ihre im in ist ja jede jeder jedes kein keine man mein mit nach nicht noch nun nur ob oder ohne sein seine seit sich sie sind so sobald über um und uns unser unter "
    "viele vom von vor wann warum was weil welche welcher welches wem wen wenn wer werden wessen wie wieviel wir wird wo woher wohin während zu zum zur zwar zwischen "
    "au aucun aussi autre aux avec avant car ce cela ces cet cette chaque chez ci combien comme comment dans de depuis des donc dont du elle elles en entre est et étaient était être eux "
    "il ils je jamais jusque la le les leur leurs lors lorsque lui mais même mes mon ne ni nos notre nous on où ou par parce pas pendant plus plusieurs pour pourquoi puis puisque quand que quel quelle quelles quels qui quoi "
    "sa sans se selon ses si son sont sous sur ta tes ton tous tout toute toutes très tu un une vers vos votre vous "
    "al algún antes aquel aunque cada como cómo con cual cuál cuando cuándo cuánta cuántas cuánto cuántos cuyo del desde después donde dónde durante él el ella ellas ellos entonces era es esa ese eso esta está este estos "
    "ha hasta hay las lo los más me mi mientras muy nada ni no nosotros nuestra nuestro o para pero por porque pues qué quien quién según ser si sí sin sino sobre solo su sus también tan tanto te todo todos tu un una unas uno unos usted y ya yo"
).split()
NUMBER, NAME, UNIT, GAP = "0", "\x02", "\x03", "\x04"
#: Before a capitalised word that is no function word, wherever it stands.
NAMED = f"(?=\\p{{Lu}}\\p{{Ll}})(?<![\\p{{L}}\\p{{M}}])(?!(?:{'|'.join(sorted({w.capitalize() for w in FUNCTION if len(w) > 1}))})(?![\\p{{L}}\\p{{M}}]))"
TOKEN = "\x02?[\\p{L}\\p{M}]++|[0-9]++(?:[.,][0-9]++)*+"


def tokens(text: Column) -> Column:
    """Words and numbers in order; a capitalised word that is no function word, so a likely name, begins with a mark.

    What stands before a word does not matter, so an item's words are read alike wherever the item stands.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), NAME, " ")
    marked = F.regexp_replace(clean, NAMED, NAME)
    return F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0))


def _is_number(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def template(words: Column, low: Column | None = None) -> Column:
    """Numbers, units after a number and names become placeholders; the rest is lower-cased, or read from ``low``, the ``plain`` words."""
    after_number = lambda i: (i > 0) & F.coalesce(_is_number(F.get(words, i - 1)), F.lit(False))

    def one(t: Column, i: Column) -> Column:
        lower = F.lower(t) if low is None else low[i]
        out = F.when(_is_number(t), F.lit(NUMBER)).when(F.startswith(t, F.lit(NAME)), F.lit(NAME))
        return out.when(lower.isin(UNITS) & after_number(i), F.lit(UNIT)).otherwise(lower)

    return F.transform(words, one)


def plain(words: Column) -> Column:
    return F.transform(words, lambda t: F.lower(F.ltrim(t, F.lit(NAME))))


def window_hashes(hs: Column, width: int) -> Column:
    """A hash of each run of ``width`` values, from hashes of pairs, pairs of pairs and so on; null for fewer values."""
    joined = lambda a, b, at: F.zip_with(a, F.slice(b, at + 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    def grow(part: Column, long: int, done: Column | None, have: int) -> Column:
        rest = (width - have) // long
        if rest % 2:
            done, have = part if done is None else joined(done, part, have), have + long
        if have == width:
            return F.when(F.size(hs) >= width, F.slice(done, 1, F.greatest(F.size(hs) - (width - 1), F.lit(0))))
        return let(joined(part, part, long), lambda p: grow(p, 2 * long, done, have))

    return grow(hs, 1, None, 0)


def windows(words: Column, width: int = WINDOW, literals: int = LITERALS) -> Column:
    """(hash, place, slot values) of each run of ``width`` tokens, read with names as placeholders and as they stand.

    Either reading counts where it has ``literals`` real words or more; a run without names has one reading.
    Fewer tokens than ``width`` are one window as a whole, whatever it holds.
    """

    def of(low: Column, ts: Column) -> Column:
        numeric = lambda x: x.isin(NUMBER, UNIT)
        # Per token 16 for a name and 1 for another placeholder, so that one sum over a window counts both.
        codes = F.transform(ts, lambda x: F.when(x == NAME, F.lit(16)).when(numeric(x), F.lit(1)).otherwise(F.lit(0)))
        masked = F.transform(ts, lambda x: F.xxhash64(x))
        stand = F.transform(ts, lambda x, i: F.when(x == NAME, F.xxhash64(low[i])).otherwise(F.xxhash64(x)))
        all_values = F.transform(ts, lambda x, i: F.when((x == NAME) | numeric(x), low[i]).otherwise(F.lit("")))
        numbers = F.transform(ts, lambda x, i: F.when(numeric(x), low[i]).otherwise(F.lit("")))

        def each(codes: Column, readings: list[tuple[Column, Column]]) -> Column:
            starts = F.slice(codes, 1, F.greatest(F.size(codes) - (width - 1), F.lit(0)))
            sums = F.transform(starts, lambda _, i: sum((codes[i + k] for k in range(1, width)), codes[i]))
            names, others = lambda c: F.shiftright(c, 4), lambda c: c.bitwiseAND(15)

            def run(sums: Column, hw: Column, vs: Column, slots: Callable[[Column], Column], wanted: Callable[[Column], Column]) -> Column:
                text = lambda c, i: F.when(slots(c) > 0, F.array_join(F.slice(vs, i + 1, width), GAP))
                one = lambda c, i: F.struct(hw[i].alias("hash"), i.alias("pos"), text(c, i).alias("slots"))
                return F.transform(sums, lambda c, i: F.when(wanted(c) & (slots(c) <= width - literals), one(c, i)))

            def both(sums: Column) -> Column:
                kinds = [(lambda c: names(c) + others(c), lambda c: F.lit(True)), (others, lambda c: names(c) > 0)]
                reading = lambda hs, vs, kind: let(window_hashes(hs, width), lambda hw: run(sums, hw, vs, *kind))
                return F.array_compact(F.concat(*[reading(hs, vs, kind) for (hs, vs), kind in zip(readings, kinds, strict=True)]))

            whole = F.array_distinct(F.array(*[F.struct(F.xxhash64(hs, F.size(hs)).alias("hash"), F.lit(0).alias("pos"), F.array_join(vs, GAP).alias("slots")) for hs, vs in readings]))
            short = F.when(F.size(codes) > 0, whole).otherwise(F.slice(whole, 1, 0))
            return F.when(F.size(codes) < width, short).otherwise(let(sums, both))

        return let(codes, lambda c: let(masked, lambda hm: let(all_values, lambda vm: let(stand, lambda hs: let(numbers, lambda vs: each(c, [(hm, vm), (hs, vs)]))))))

    return let(words, lambda ws: let(plain(ws), lambda low: let(template(ws), lambda ts: of(low, ts))))


def bit_table(known: DataFrame) -> tuple[Column, int]:
    """A table with a bit for each window hash, as a scalar, and its number of bits.

    It grows with the benchmark up to ``MOST_BITS``; beyond that more windows pass it and are left to the join.
    """
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 64 * known.count()):
        bits *= 2
    place = F.col("hash").bitwiseAND(bits - 1)
    filled = known.select(F.shiftright(place, 6).cast("int").alias("word"), place.bitwiseAND(63).cast("int").alias("bit")).distinct()
    filled = filled.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    # Every word has a row, so the table is a sorted list; looking words up in a map would take the square of their number.
    words = known.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(filled, "word", "left")
    listed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    table = words.agg(listed.alias("words")).select(F.transform("words", lambda x: x["bits"]).alias("t"))
    return cut_lineage(table).scalar(), bits


def blocks(words: Column, least: int, width: int = WINDOW) -> Column:
    """(base, lead, words) of each run of ``BLOCK`` places where a run of ``least`` tokens can begin; none for no tokens.

    A block goes on for ``width`` - 1 more tokens, and all but the first have the token before them (``lead``
    1), so runs and placeholders are read as in the whole text.
    """

    def one(ws: Column, i: Column) -> Column:
        lead = F.when(i > 0, F.lit(1)).otherwise(F.lit(0))
        return F.struct(i.alias("base"), lead.alias("lead"), F.slice(ws, i - lead + 1, lead + (BLOCK + width - 1)).alias("words"))

    starts = lambda ws: F.sequence(F.lit(0), F.greatest(F.size(ws) - least, F.lit(0)), F.lit(BLOCK))
    return let(words, lambda ws: F.when(F.size(ws) > 0, F.transform(starts(ws), lambda i: one(ws, i))))


def met_windows(docs: DataFrame, text: str, known: DataFrame, width: int = WINDOW) -> DataFrame:
    """(at, hash, pos, slots) of those ``windows`` whose hash has its bit in the table of the known ones.

    Texts are read in ``blocks``, so what is kept beside a window does not grow with its text. Hashes of all
    windows in both readings come first; slots are read only for windows that hit. A window that meets one
    of an item has the item's template, so its real words need no count of their own.
    """
    table, bits = bit_table(known)
    hit = lambda h: F.getbit(table[F.shiftright(h.bitwiseAND(bits - 1), 6).cast("int")], h.bitwiseAND(63).cast("int")) == 1

    def hashes(hs: Column) -> Column:
        whole = F.when(F.size(hs) > 0, F.array(F.xxhash64(hs, F.size(hs)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(hs) < width, whole).otherwise(window_hashes(hs, width))

    def read(low: Column, ts: Column) -> Column:
        masked = F.transform(ts, lambda x: F.xxhash64(x))
        stand = lambda hm: F.transform(ts, lambda x, i: F.when(x == NAME, F.xxhash64(low[i])).otherwise(hm[i]))
        both = lambda hm, m: F.struct(ts.alias("ts"), low.alias("low"), m.alias("masked"), F.when(F.array_contains(ts, NAME), let(stand(hm), hashes)).otherwise(m).alias("stand"))
        return let(masked, lambda hm: let(hashes(hm), lambda m: both(hm, m)))

    def slots(kinds: list[str]) -> Column:
        part = F.slice("d.ts", F.col("pos") + 1, width)
        values = F.transform(part, lambda x, k: F.when(x.isin(kinds), F.col("d.low")[F.col("pos") + k]).otherwise(F.lit("")))
        return F.when(F.exists(part, lambda x: x.isin(kinds)), F.array_join(values, GAP))

    rows = docs.select("at", F.explode(blocks(tokens(docs[text]), width, width)).alias("b"))
    own = lambda words: F.slice(words, F.col("b.lead") + 1, BLOCK + width)
    both = lambda low: let(own(template(F.col("b.words"), low)), lambda ts: let(own(low), lambda lw: read(lw, ts)))
    rows = rows.select("at", F.col("b.base").alias("base"), let(plain(F.col("b.words")), both).alias("d"))
    rows = rows.select("at", "base", "d", F.posexplode("d.masked").alias("pos", "m")).withColumn("s", F.col("d.stand")[F.col("pos")])
    rows = rows.withColumn("met_m", hit(F.col("m"))).withColumn("met_s", (F.col("s") != F.col("m")) & hit(F.col("s"))).where("met_m OR met_s")
    # Both readings of a window without names are one.
    one = lambda h, kinds: F.when(F.col(f"met_{h}"), F.struct(F.col(h).alias("hash"), slots(kinds).alias("slots")))
    both = F.array(one("m", [NUMBER, UNIT, NAME]), one("s", [NUMBER, UNIT]))
    rows = rows.select("at", "base", "pos", F.explode(F.array_compact(both)).alias("w"))
    return rows.select("at", "w.hash", (F.col("base") + F.col("pos")).alias("pos"), "w.slots")


def sent(known: DataFrame) -> DataFrame:
    """The stored rows marked for sending to all tasks if few and small: at most ``SENT_ROWS`` and ``SENT_BYTES`` of them."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in known.dtypes if t == "string"]
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(64))), F.lit(0))).first()
    return F.broadcast(known) if n <= SENT_ROWS and size <= SENT_BYTES else known


def item_windows(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    """Windows of each item, and how many places it has."""
    both = windows(tokens(benchmark[text]))
    rows = benchmark.select(benchmark[item_id].alias("item"), F.xxhash64(benchmark[text]).alias("mark"), F.explode(both).alias("w"))
    rows = rows.select("item", "mark", "w.hash", F.col("w.pos").alias("q"), F.col("w.slots").alias("item_slots")).distinct()
    sizes = rows.groupBy("item", "mark").agg(F.count_distinct("q").alias("places"))
    return join_null_safe(rows, sizes, ["item", "mark"])


def runs(words: Column, n: Column, most: int | None = None) -> Column:
    """(n, hash, place) of each run of ``n`` tokens as they stand, numbers and units too; those at the first ``most`` places."""

    def of(low: Column) -> Column:
        places = F.greatest(F.size(low) - (n - 1), F.lit(0))
        starts = F.slice(low, 1, places if most is None else F.least(places, F.lit(most)))
        return F.transform(starts, lambda _, i: F.struct(n.alias("n"), F.xxhash64(F.slice(low, i + 1, n)).alias("hash"), i.alias("pos")))

    return let(plain(words), of)


def too_short(benchmark: DataFrame, item_text: str = "text", item_id: str = "item_id", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(item, tokens) of the items under ``least_tokens`` tokens, which are not searched for inside longer texts."""
    sized = benchmark.select(benchmark[item_id].alias("item"), F.size(tokens(benchmark[item_text])).alias("tokens"))
    return sized.where(F.col("tokens") < least_tokens)


def exact_leaks(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, item_id: str, least_tokens: int) -> DataFrame | None:
    """(at, item) for each document that holds, word for word, an item that has no window of its own; None without such items.

    Items shorter than a window are runs of their own length; longer ones of which no window has enough
    real words are found by all their runs of ``WINDOW`` tokens along one alignment. So documents are
    cut into runs of at most ``WINDOW`` lengths, those that occur.
    """
    words = tokens(benchmark[item_text])
    own = benchmark.select(benchmark[item_id].alias("item"), F.xxhash64(benchmark[item_text]).alias("mark"), words.alias("words"))
    own = own.where((F.size("words") >= max(1, least_tokens)) & ((F.size("words") < WINDOW) | (F.size(windows(F.col("words"))) == 0)))
    n = F.least(F.size("words"), F.lit(WINDOW))
    known = own.select("item", "mark", (F.size("words") - n + 1).alias("places"), F.explode(runs(F.col("words"), n)).alias("r"))
    known = cut_lineage(known.select("item", "mark", "places", "r.n", "r.hash", F.col("r.pos").alias("q")).distinct())
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
    if not lengths:
        return None
    found = docs.select("at", F.explode(blocks(tokens(docs[text]), 1)).alias("b"))
    own = F.slice("b.words", F.col("b.lead") + 1, BLOCK + WINDOW)
    found = found.select("at", "b.base", F.explode(let(own, lambda ws: F.concat(*[runs(ws, F.lit(k), BLOCK) for k in lengths]))).alias("r"))
    hits = found.select("at", "r.n", "r.hash", (F.col("base") + F.col("r.pos")).alias("p")).join(sent(known), ["n", "hash"])
    shift = F.when(F.col("places") > 1, F.col("p") - F.col("q")).otherwise(F.lit(0)).alias("shift")
    met = hits.select("at", "item", "mark", shift, "q", "places").distinct().groupBy("at", "item", "mark", "shift").agg(F.count("*").alias("met"), F.max("places").alias("places"))
    return met.where("met = places").select("at", "item")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", coverage: float = COVERAGE, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(at, item) for each document that holds ``coverage`` of an item's windows; ``docs`` has a column at.

    Documents and items are windowed alike, so a verbatim copy meets every place. Windows meet by hash. Along one alignment of document and item every value of the item must stand
    for one value of the document; alignments that break this do not count. A bit table of the benchmark's
    hashes keeps windows that meet nothing out of the join; up to ``SENT_ROWS`` windows of at most ``SENT_BYTES`` are then sent to all
    tasks, more are joined by exchange. Items without a window, or shorter than one, are found by
    ``exact_leaks`` from ``least_tokens`` tokens on; ``too_short`` lists the others.
    """
    known = cut_lineage(item_windows(benchmark, item_text, item_id))
    hits = met_windows(docs, text, known).withColumnRenamed("pos", "p").join(sent(known), "hash")
    hits = cut_lineage(hits.select("at", "item", "mark", (F.col("p") - F.col("q")).alias("shift"), "q", "slots", "item_slots", "places"))
    line = ["at", "item", "mark", "shift"]
    pairs = hits.where("slots IS NOT NULL AND item_slots IS NOT NULL").select(*line, F.split("item_slots", GAP).alias("i"), F.split("slots", GAP).alias("d"))
    pairs = pairs.select(*line, F.explode(F.arrays_zip("i", "d")).alias("x")).select(*line, "x.i", "x.d").where("i != '' AND d != ''").distinct()
    broken = pairs.groupBy(*line, "i").agg(F.count("*").alias("n")).where("n > 1").select(*line).distinct()
    kept = join_null_safe(hits, broken, line, "left_anti").groupBy("at", "item", "mark").agg(F.count_distinct("q").alias("met"), F.max("places").alias("places"))
    kept = kept.where(F.col("met") >= F.lit(coverage) * F.col("places")).select("at", "item")
    exact = exact_leaks(docs, benchmark, text, item_text, item_id, least_tokens)
    return (kept if exact is None else kept.unionByName(exact)).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Every document with ``items``, the sorted ids of the benchmark items it holds, and ``contaminated``.

    A null or empty text holds nothing, and a null or empty item is held by nothing; an item of fewer
    than ``WINDOW`` tokens is held by a text that is its template as a whole, or that has it anywhere as
    it stands, as are longer items without a window of three real words (an item under ``LEAST_TOKENS``
    tokens only as a whole text, see ``too_short``); repeated rows are judged alike; without
    documents there are no rows, without items nothing is contaminated; input columns with a computed
    name are replaced. Rows are numbered once and stored with their number.
    """
    rows = placed(docs)
    held = leaks(rows.select("at", F.col("row_").getField(text).alias("text")), benchmark, "text", **options).groupBy("at").agg(F.sort_array(F.collect_set("item")).alias("items"))
    df = rows.join(held, "at", "left")
    none = F.slice(F.array(F.lit(0).cast(held.schema["items"].dataType.elementType)), 1, 0)
    return unpacked(df, docs.columns, {"items": F.coalesce("items", none), "contaminated": F.col("items").isNotNull()})


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; an empty table, an
    empty benchmark, very long texts and clashing names are treated as in ``contamination``.
    """
    rows = placed(docs)
    held = leaks(rows.select("at", F.col("row_").getField(text).alias("text")), benchmark, "text", **options).select("at").distinct()
    return unpacked(rows.join(held, "at", "left_anti"), docs.columns, {})
