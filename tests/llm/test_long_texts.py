"""Texts far longer than usual."""

import re
import time

from pyspark.sql import functions as F

from demandloom.llm import decontaminate, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def addresses(n):
    return "é😀 " + " ".join(f"u{i}@host{i}.org" for i in range(n)) + " end"


def test_places_across_blocks(spark):
    """Texts with one match less, as many and one more than fill a block of parts."""
    half = pii.BLOCK // 2
    texts = [addresses(n) for n in (0, 1, half - 1, half, half + 1, 2 * half, 5 * half + 3)] + ["", "a@b.c", "a@b.c, " * (half + 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", pii.spans(F.col("t"), pii.BASE["email"], "email").alias("s")).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), m.end(), m.group()) for m in EMAIL.finditer(t)]
        assert [(s.start, s.end, s.value) for s in got[i]] == want
        ends = [0, *[e for _, e, _ in want]]
        assert [s.left for s in got[i]] == [t[a:b][-pii.CONTEXT :] for a, (b, _, _) in zip(ends, want)]


def test_work_per_match_is_constant(spark):
    """A text of 2 MB with a hundred thousand addresses ends, in about eight times the time of one with an eighth of them."""

    def seconds(n):
        df = spark.createDataFrame([(addresses(n),)], "t string")
        begun = time.time()
        assert df.select(F.size(pii.spans(F.col("t"), pii.BASE["email"], "email"))).first()[0] == n
        return time.time() - begun

    seconds(12_500)  # start-up
    assert seconds(100_000) < 8 * 3 * max(seconds(12_500), 0.5)


def test_items_across_blocks(spark):
    """An item of one window, one with a number before its unit and one without a window, at all places around the end of a block."""
    items, seen = ("grey birds cross cold rivers", "runs 5 km each long day", "add 3 apples"), ("grey birds cross cold rivers", "runs 7 km each long day", "add 3 apples")
    docs = [(10 * at + k, " ".join(["word"] * at + [t] + ["word"] * 200)) for at in range(decontaminate.BLOCK - 8, decontaminate.BLOCK + 4) for k, t in enumerate(seen)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate.contamination(df, benchmark).collect()} == {i: [i % 10] for i, _ in docs}


def test_windows_are_read_in_blocks(spark):
    """No row from which windows are hashed holds more than a block of a text of 20,000 words, and the blocks hold all of it."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}word" for i in range(20_000)]
    df = spark.createDataFrame([(0, " ".join(words))], "at bigint, text string")
    parts = df.select(F.explode(decontaminate.blocks(decontaminate.tokens(df.text), decontaminate.WINDOW)).alias("b")).select("b.*").collect()
    assert max(len(p["words"]) for p in parts) <= decontaminate.BLOCK + decontaminate.WINDOW
    assert [w for p in sorted(parts, key=lambda p: p["base"]) for w in p["words"][p["lead"] :][: decontaminate.BLOCK]] == words
    known = spark.createDataFrame([(1,)], "hash bigint")
    plan = decontaminate.met_windows(df, "text", known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Generate explode(transform(array(regexp_extract_all"), plan


def test_bit_table(spark):
    """A bit for each hash and no other, for hashes of either sign."""
    hashes = [(i * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for i in range(3000)]
    table, bits = decontaminate.bit_table(spark.createDataFrame([(h,) for h in hashes], "hash bigint"))
    words = spark.range(1).select(table.alias("t")).first()["t"]
    assert len(words) * 64 == bits >= 64 * len(hashes)
    assert {64 * w + b for w, x in enumerate(words) for b in range(64) if x >> b & 1} == {h & bits - 1 for h in hashes}
