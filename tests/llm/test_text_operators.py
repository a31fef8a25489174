"""Every text operator on edge cases, and against plain Python."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from demandloom.llm import decontaminate, jaccard, linededup, mixing, pii, quality, queries, sharding, tokencount, toxicity, urlfilter
from demandloom.llm.columns import stored
from tests.llm import brute
from tests.llm.brute import SF_DIR

BPE = public_tokenizers.path("byte_bpe_50k.json")


def bench(spark, texts=("a b c d e f g", None, "", "one two")):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.contamination(d, bench(s)),
    "tokencount": lambda s, d: tokencount.count_tokens(d, BPE),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, toxicity.categories_of(labels(s)))),
    "jaccard": lambda s, d: jaccard.jaccard_groups(d),
    "pii": lambda s, d: pii.find(d),
    "quality": lambda s, d: quality.judge(d),
    "linededup": lambda s, d: linededup.dedup_lines(d),
    "urlfilter": lambda s, d: urlfilter.filter_urls(d, url="text"),
    "mixing": lambda s, d: mixing.mix(d),
    "sharding": lambda s, d: sharding.shard(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, edge, empty, edge_rows, name):
    """One row per row, also for nulls, long texts, repeats and clashing names; none for an empty table."""
    out = OPERATORS[name](spark, edge)
    assert len(out.columns) == len({c.lower() for c in out.columns})
    rows = out.collect()
    assert len(rows) == len(edge_rows)
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in edge_rows)
    assert OPERATORS[name](spark, empty).count() == 0


def test_filters_keep_columns(spark, edge, empty, edge_rows):
    for df, n in ((edge, len(edge_rows)), (empty, 0)):
        assert decontaminate.decontaminated(df, bench(spark)).columns == df.columns
        assert mixing.mixed(df).columns == df.columns
        one = jaccard.one_of_each(df)
        assert one.columns == df.columns
        assert one.count() == (len(set(brute.groups([r[1] for r in edge_rows])[0])) if n else 0)


def test_quality(spark, edge, edge_rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {tuple(r) for r in quality.judge(edge).select("text", *names).collect()}
    assert got == {(r[1], *brute.quality(r[1])) for r in edge_rows}


def test_quality_repeats(spark):
    random.seed(4)
    texts = [" ".join(random.choices("a b c".split(), k=random.randint(0, 60))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(df).collect()}
    assert got == {i: brute.quality(t)[4] for i, t in enumerate(texts)}


def test_quality_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "the word " * 3 + "one two three four five six seven"), (2, "Of%%% the&&& on*** " * 1 + "a b c d e f g h i j k")], "doc_id bigint, text string")
    strict = (quality.Rule("symbols", "symbols_per_word", None, 0.0),)
    assert {r["doc_id"]: (r["kept"], r["broken_rules"]) for r in quality.judge(df, rules=strict).collect()} == {1: (True, []), 2: (False, ["symbols"])}


def test_line_dedup(spark, edge, edge_rows, documents):
    docs = [(d["doc_id"], d["text"]) for d in documents]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for frame, rows, least in ((df, docs, 10), (df, docs, 2), (edge, [r[:2] for r in edge_rows], 1), (edge, [r[:2] for r in edge_rows], 2)):
        out = linededup.dedup_lines(frame, min_docs=least).select("doc_id", "text", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256))
        assert Counter(map(tuple, out.collect())) == Counter((*r, *k) for r, k in zip(rows, brute.kept_lines(rows, least), strict=True))


def test_line_dedup_keeps_first_and_spreads(spark):
    df = spark.createDataFrame([(i, f"hot line\nown {i}\nHot Line ") for i in range(200)], "doc_id bigint, text string")
    assert linededup.dedup_lines(df).agg(F.sum("n_dropped")).first()[0] == 400
    first = linededup.dedup_lines(df, keep="first")
    assert first.agg(F.sum("n_dropped")).first()[0] == 399
    where = linededup.occurrences(df, "text", "doc_id", 1).where(F.col("h1") == F.xxhash64(F.lit("hot line")))
    assert where.select("salt").distinct().count() > 8


def test_keep_bitmaps_hold_long_documents(spark):
    lines = [f"own {i}" if i % 3 else "shared" for i in range(1000)]
    df = spark.createDataFrame([(k, "\n".join(lines)) for k in range(10)] + [(99, "shared")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in linededup.dedup_lines(df, min_docs=11).collect()}
    assert out[3]["n_dropped"] == 334 and out[3]["kept_text"].split("\n") == [x for x in lines if x != "shared"]
    assert out[99]["kept_text"] == "" and len(out[3]["keep"]) == 16


def test_token_counts(spark, edge, edge_rows, documents):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    docs = [(d["doc_id"], d["text"]) for d in documents] + [r[:2] for r in edge_rows]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = Counter((i, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in docs)
    for common in (tokencount.COMMON, 50, 1):
        assert Counter(map(tuple, tokencount.count_tokens(df, BPE, common=common).collect())) == want


def test_token_counts_refuse_other_kinds():
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.check(public_tokenizers.path("word_bpe_49k.json"))


def jaccard_rows(df, **options):
    return Counter(map(tuple, jaccard.jaccard_groups(df, **options).collect()))


def test_jaccard(spark, edge_rows, documents):
    random.seed(1)
    base = [f"w{i}" for i in range(120)]
    near = []
    for k in range(60):  # one large group of near copies, whose pairs are partly below the threshold
        w = list(base)
        for _ in range(k % 9):
            w[random.randrange(120)] = f"x{random.random()}"
        near.append(" ".join(w))
    texts = [d["text"] for d in documents] + near + [r[1] for r in edge_rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for k, percent in ((4, 85), (5, 80), (1, 50)):
        group, n = brute.groups(texts, k, percent)
        assert jaccard_rows(df, words=k, percent=percent) == Counter(zip(range(len(texts)), n, group, strict=True))


def test_jaccard_hot_tiles(spark, monkeypatch):
    """A hot group cut into many blocks gives the same groups as small tiles do."""
    random.seed(9)
    texts = []
    for size in (60, 1500):  # the larger sets fill whole words of the bitmaps
        base = [f"w{size}.{i}" for i in range(size)]
        for k in range(80):
            w = list(base)
            for i in random.sample(range(size), size // 60 * (k % 6)):
                w[i] = f"x{random.randrange(40)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    group, n = brute.groups(texts, 4, 85)
    assert len(set(group)) > 3
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    assert jaccard_rows(df) == Counter(zip(range(len(texts)), n, group, strict=True))


def test_jaccard_links(spark, edge_rows, documents, monkeypatch):
    """Every link is in the table, whether its shingles are common or not and its tiles small or hot."""
    random.seed(4)
    base = [f"w{i}" for i in range(80)]
    near = [" ".join(w if random.random() > 0.01 else f"x{random.randrange(9)}" for w in base) for _ in range(60)]
    texts = [d["text"] for d in documents[:300]] + near + near[:5] + [r[1] for r in edge_rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [brute.shingles(t, 4) for t in texts]
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])}
    count = Counter(x for pair in want for x in pair)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)  # small tables have common shingles only if all rows are sampled
    for hot in (jaccard.HOT, 3):
        monkeypatch.setattr(jaccard, "HOT", hot)
        links, members = (x.collect() for x in jaccard.jaccard_links(df))
        assert {r["doc_id"]: r["n_links"] for r in members} == {i: count[i] for i in range(len(texts))}
        of = {r["doc_id"]: r["class_id"] for r in members}
        got = {(r["a"], r["b"]) for r in links}
        assert len(got) == len(links) and got == {tuple(sorted((of[i], of[j]))) for i, j in want if of[i] != of[j]}


def test_jaccard_spreads_common_shingles(spark):
    """Rows of a shingle that all classes share lie in groups by salt, and no window gathers them."""
    texts = [" ".join(["same"] * 5 + [f"w{k}.{i}" for i in range(3)]) for k in range(640)]
    df = spark.createDataFrame(list(enumerate(texts)), "at bigint, text string")
    common = jaccard.common_shingles(df, 4)
    assert len(common)
    hits = jaccard.shared_prefixes(df, 4, 10, common)
    salts = hits.where("salt >= 0").groupBy("token", "salt").count().collect()
    assert len(salts) >= jaccard.SALTS and max(r["count"] for r in salts) < 640 / 10
    met = jaccard.over_tokens(hits, {"met": F.count("*")}).collect()
    size = Counter(r["token"] for r in met)
    assert all(r["met"] == size[r["token"]] for r in met) and max(size.values()) == 640


def test_jaccard_prefixes_cover():
    for n in range(1, 400):
        for percent in (50, 80, 85, 100):
            p, q = jaccard.prefix_sizes(n, percent)
            assert 1 <= q <= p <= n
            assert 100 * (n - p) < percent * n <= 100 * (n - p + 1)


def pii_rows(df):
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k))
    n = map(count, pii.KINDS)
    return pii.find(df).select("text", *n, pii.joined(F.col("base")), pii.joined(F.col("spans"))).collect()


def test_personal_data(spark, edge_rows, documents):
    random.seed(2)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", ".", "-", " ", "é", "a", "+49.30.1234567", "(", "\n", "%", "7" * 17]
    texts = ["".join(random.choices(parts, k=random.randint(1, 14))) for _ in range(400)] + [d["text"] for d in documents] + [r[1] for r in edge_rows]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {t: brute.personal(t) for t in texts}
    for t, *n, base, spans in pii_rows(df):
        assert (n, base) == (want[t][0], want[t][1]), t
        assert set(filter(None, base.split(","))) <= set(spans.split(","))


def test_personal_data_extra_spans_and_redaction(spark):
    random.seed(3)
    rows = []
    for i in range(300):
        n = "".join(random.choices("0123456789", k=10))
        rows += [f"write to user{i}@mail.example.org today", f"call +1 {n[:3]} {n[3:6]} {n[6:]} now", f"build v{n[:4]}abc{n[4:7]} ok"]
    rows += ["write to someone(at)mail.example.org today"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    out = pii.find(df).withColumn("clean", pii.redacted(F.col("text"), F.col("spans")))
    got = {r["text"]: r for r in out.collect()}
    assert got[rows[0]]["clean"] == "write to [email] today" and got[rows[1]]["clean"] == "call [phone] now"
    assert not got[rows[2]]["spans"]


def test_personal_data_recall_on_held_out_plants(spark):
    docs = spark.read.parquet(f"{os.path.dirname(SF_DIR)}/sf0.01/documents.parquet").select("doc_id", "text")
    out = pii.held_out(docs).collect()
    for r in out:
        assert r["n"] > 50 and (r["taken"] >= 0.9 * r["n"] if r["label"] else r["taken"] <= 0.05 * r["n"]), r
    assert {r["kind"] for r in out if r["label"]} == set(pii.KINDS)


def test_personal_data_learns_from_every_document(spark):
    """Every checked proposal and a plant of every document are examples, however many there are."""
    n = 21_000
    df = spark.range(n).select(F.col("id").alias("at"), F.concat(F.lit("words then 10.0.0."), F.col("id") % 400, F.lit(" and more words")).alias("text"))
    plants, all_ = pii.planted(df), len(pii.forms(F.col("text")))
    assert plants.count() == n * pii.PLANTS and plants.groupBy("kind", "label").count().count() == 8
    assert pii.planted(df.limit(700), all_).count() == 700 * all_
    found = stored(pii.candidates(df))
    alone = dict(map(tuple, pii.examples(found, plants.limit(0)).groupBy("label").agg(F.sum("n")).collect()))
    fine = sum(i % 400 <= 255 for i in range(n))
    assert alone[1.0] == fine and alone[0.0] >= n - fine
    both = dict(map(tuple, pii.examples(found, plants.where("label = 1")).groupBy("label").agg(F.sum("n")).collect()))
    assert both == {1.0: fine + plants.where("label = 1").count(), 0.0: alone[0.0]}


def test_personal_data_overlaps(spark):
    """A span that was dropped for an overlap drops no other."""
    rows = [(1, "a", 0, 10), (1, "b", 5, 15), (1, "c", 12, 20), (1, "d", 19, 25), (1, "e", 20, 22), (1, "f", 30, 31), (2, "a", 3, 4), (2, "b", 3, 9), (2, "c", 9, 12), (3, "a", 1, 2)]
    got = pii.disjoint(spark.createDataFrame(rows, "at bigint, kind string, start bigint, end bigint")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0, 10), (1, "c", 12, 20), (1, "e", 20, 22), (1, "f", 30, 31), (2, "b", 3, 9), (2, "c", 9, 12), (3, "a", 1, 2)]


def test_mixing_exchanges_whole_rows_once(spark, edge):
    """The rows, texts included, meet their starts where they were ranked."""
    sent = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mixed(edge)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert len(exchanges) > 1 and sum("row_#" in x for x in exchanges) == 1, plan


def test_decontamination(spark):
    item = "A train from the old station travels 60 km in 3 hours, and then Alice asks how fast the 3 drivers went home"
    other = "Le petit chat regarde la lune et pense que la nuit sera longue sans son ami"
    again = item.replace("60", "85").replace("3", "4").replace("Alice", "Robert")
    clash = item.replace("60", "85").replace("3 hours", "4 hours").replace("3 drivers", "7 drivers")
    part = " ".join(item.split()[:9])
    docs = [
        (0, f"Before this. {item}. After that."), (1, f"Before {again} after"), (2, f"So {clash} end"), (3, f"Only {part} and no more of it"),
        (4, item.upper()), (5, item.lower()), (6, f"{item}\n{other}"), (7, "nothing here"), (8, None), (9, "60 3 3"), (10, "one two"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    out = decontaminate.contamination(df, bench(spark, (item, other, None, "", "one two")))
    assert {r["doc_id"]: r["items"] for r in out.collect()} == {0: [0], 1: [0], 2: [], 3: [], 4: [0], 5: [0], 6: [0, 1], 7: [], 8: [], 9: [], 10: [4]}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(df, bench(spark, (item, other))).collect()) == [2, 3, 7, 8, 9, 10]


def items_of(spark, texts, items):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["items"] for r in decontaminate.contamination(df, bench(spark, items)).collect()}


def test_decontamination_of_capitalised_text(spark):
    """Verbatim copies full of capitalised words: title case, German nouns, lists of names."""
    items = (
        "What Is The Capital City Of France",
        "Im Garten steht der Hund neben Baum, Zaun, Haus, Auto und Fahrrad, während Katze, Maus, Vogel und Igel im Schatten der Hecke schlafen",
        "Choose one of Berlin, Madrid, Paris, London, Rome, Vienna, Lisbon, Prague or Oslo as the place",
    )
    texts = [f"so we read this: {x}. and more of it" for x in items] + ["so we read What Is The Best Way Of Life. and more of it"]
    assert items_of(spark, texts, items) == {0: [0], 1: [1], 2: [2], 3: []}


def test_decontamination_without_windows(spark):
    """Items too short for a window, or without three real words in any, are found where they stand."""
    items = ("Compute 12 + 34 * 56 - 78", "Add 3 apples", "7 7 7 7 7 7 9", "Solve 1 2 3 4 5 6", None, "")
    texts = [
        "so please compute 12 + 34 * 56 - 78 at once", "Compute 12 + 34 * 56 - 79", "you add 3 apples to the lot", "you add 4 apples to the lot", "Add 5 apples",
        "see 7 7 7 7 7 7 7 9 there", "7 7 7 7 7 8 9", "Solve 1 2 3 4 5 and 2 3 4 5 6", "solve 1 2 3 4 5 6", "Add 3", None, "",
    ]
    assert items_of(spark, texts, items) == {0: [0], 1: [], 2: [1], 3: [], 4: [1], 5: [2], 6: [], 7: [], 8: [3], 9: [], 10: [], 11: []}


def test_decontamination_of_names_that_open_sentences(spark):
    """A name is a name at the start of a sentence too, and an item is read alike after a colon or a lower-case word."""
    apples = "Alice has 5 red apples. Alice gives 2 to Tom. How many apples does Alice have left?"
    short = ("What did the old Tom buy", "Which river did the tall Anna cross by boat")
    maria = apples.replace("Alice", "Maria")
    texts = [maria, f"Question: {maria} Answer: 3", maria.replace("2", "4").replace("Tom", "Jim"), maria.replace("does Maria", "does Jane")]
    texts += [f"Question: {x}?" for x in short] + [f"the question {x}".replace("Tom", "Jim").replace("Anna", "Eve") for x in short]
    assert items_of(spark, texts, (apples, *short)) == {0: [0], 1: [0], 2: [0], 3: [], 4: [1], 5: [2], 6: [1], 7: [2]}


def test_decontamination_of_documents(spark, documents):
    items = pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()
    plain = lambda t: " ".join(re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*", (t or "").lower()))
    want = {d["doc_id"]: sorted(b["item_id"] for b in items if f" {plain(b['text'])} " in f" {plain(d['text'])} ") for d in documents}
    got = {r["doc_id"]: r["items"] for r in queries.QUERIES["op1_template_decontamination"](spark, SF_DIR).collect()}
    assert got == want and any(want.values())


def toxic_frame(spark, seed, n=600):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "ka lo mi ne ru so ti".split() for b in "ban del fir gos".split()]
    rows = []
    for i in range(n):
        bad, poor = rng.random() < 0.2, rng.random() < 0.2
        w = rng.choices(plain, k=rng.randint(5, 80))
        if bad:
            w[rng.randrange(len(w))] = "vilex" + rng.choice("ab ce di fo ur".split())
        if poor:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), int(not poor), int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    old, new = toxic_frame(spark, 5), toxic_frame(spark, 6)
    chain = toxicity.train(old.select("doc_id", "text"), toxicity.categories_of(old))
    rows = toxicity.score(new, chain).collect()
    assert sum(r["rejected"] == bool(r["toxic"]) for r in rows) >= 0.98 * len(rows)
    assert sum((r["p_low_quality"] > 0.5) == (not r["quality"]) for r in rows) >= 0.95 * len(rows)
    assert [len(w) for w in chain.earlier] == [0, 1]
    again = toxicity.train(old.repartition(5).select("doc_id", "text"), toxicity.categories_of(old))
    assert (again.weights == chain.weights).all()


def test_toxicity_sample_bound(spark):
    old = toxic_frame(spark, 7, 300)
    chain = toxicity.train(old.select("doc_id", "text"), toxicity.categories_of(old), sample=1)
    assert chain.features == []


def test_toxicity_sample_is_one_document_per_label(spark, monkeypatch):
    """Labels with nulls use up no sample, and documents that share an id do not exceed it."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(200)] + [(i, f"copy {k} of {i}") for i in range(0, 200, 10) for k in range(50)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, None if i % 4 == 1 else i % 2, int(i % 5 == 0)) for i in range(200)], "doc_id bigint, low_quality int, toxic int")
    fitted, real = [], toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, cols, dense, *rest: fitted.append(len(dense)) or real(rows, cols, dense, *rest))
    toxicity.train(docs, marks, sample=120)
    toxicity.train(docs, marks, sample=1000)
    assert fitted == [120, 150]


def test_url_rules(spark):
    urls = [
        None, "", "no scheme/x", "https://Example.ORG/es/1?x=1#y", "http://a.example.org/en/12", "https://org/", "https://org", "ftp://x.org/a",
        "https://a.com/fr/1", "https://a.com/de/x", "https://a.com/defoo", "https://xorg/", "://", "https://É.com/fr/", "https://a.net?q=/fr/", "https://b.org//es/",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    for r in urlfilter.filter_urls(df).collect():
        host, path, rule, verdict = brute.rule(r["url"], urlfilter.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_url_trees_on_held_out_urls(spark):
    rng = random.Random(8)
    make = lambda bad: f"https://{'win' + str(rng.randrange(10**6)) if bad else rng.choice(['news', 'blog', 'docs'])}.site.{rng.choice(['com', 'net'])}/" + "/".join(f"{rng.randrange(10**5)}" if bad else rng.choice(["about", "post", "help"]) for _ in range(rng.randint(1, 3))) + ("?a=1&b=2" if bad else "")
    sets = [[(make(bad), int(bad)) for bad in rng.choices([False, True], k=300)] for _ in range(2)]
    known, new = (spark.createDataFrame(x, "url string, label int") for x in sets)
    out = urlfilter.filter_urls(new, rules=(), labels=known).collect()
    assert sum((r["verdict"] == "block") == bool(r["label"]) for r in out) >= 0.95 * len(out)


def test_url_entropy(spark):
    texts = ["", "a", "aaaa", "abab", "https://ü.org/ab?c=1&d=22", "x" * 5000 + "y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", urlfilter.entropy(F.col("t")).alias("e")).collect():
        n = Counter(r["t"])
        assert r["e"] == pytest.approx(-sum(c / len(r["t"]) * math.log2(c / len(r["t"])) for c in n.values()), abs=1e-9)


def test_url_trees_on_held_out_hosts(spark):
    """Rates leave a URL's own hosts out: a label that goes by the host alone teaches nothing about other hosts."""
    rng = random.Random(5)
    rows = [(f"https://h{h}.site.com/p{rng.randrange(10**4)}", h % 2) for h in range(200) for _ in range(5)]
    rows += [(f"https://bad{h}.win.net/{'7' * 9}{rng.randrange(99)}?a=1", 1) for h in range(100)]
    known = spark.createDataFrame(rows, "url string, label int")
    out = urlfilter.held_out(known, rules=(), labels=known).collect()
    total = sum(r["n"] for r in out)
    right = sum(r["n"] for r in out if (r["verdict"] == "block") == bool(r["label"]))
    assert total > 100 and 0.3 * total < right < 0.85 * total


def test_url_trees_on_the_given_pages(spark):
    """What no rule decides is not judged by its first folder alone."""
    pages = spark.read.parquet(f"{os.path.dirname(SF_DIR)}/sf0.01/pages.parquet")
    rest = urlfilter.filter_urls(pages).where("rule IS NULL").select("path", "score", "verdict").collect()
    by = defaultdict(list)
    for r in rest:
        by[r["path"].split("/")[1] if "/" in r["path"] else ""].append(r["score"])
    big = [v for v in by.values() if len(v) >= 15]
    assert len(big) >= 3 and len({round(r["score"], 6) for r in rest}) > 10
    assert max(map(min, big)) < min(map(max, big))  # the folders' scores overlap


def test_mixing(spark, documents):
    docs = [(d["doc_id"], d["text"], d["source"] if i % 7 else None) for i, d in enumerate(documents)] + [(None, None, "zz"), (900, "", "zz")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = mixing.mix(df).collect()
    size = Counter()
    for d in docs:
        size[d[2]] += len(brute.words(d[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, left, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), 1.5 * sum(size.values())
    target = {}
    while True:
        share = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if 2 * size[s] < share * weight[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= over
    target |= {s: share * weight[s] for s in left}
    taken, most = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(brute.words(r["text"])) and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in order)
    key = lambda df: Counter((r["doc_id"], r["source"], r["taken"]) for r in df.collect())
    assert key(mixing.mix(df.repartition(5, "text"))) == key(mixing.mix(df))
    assert mixing.mixed(df).count() == sum(r["copies"] for r in rows)


def test_mixing_takes_text_ids(spark):
    rows = [(f"d-{i}" if i % 9 else None, "a b c " * (i % 4), "s" if i % 3 else "t") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for source in "st":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect() if r["doc_id"]}
    assert again == {r["doc_id"]: r["taken"] for r in got if r["doc_id"]}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_all_sources_at_their_caps(spark):
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(10)], "doc_id bigint, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.mix(df, share=5.0).collect()} == {(60.0, 6)}
    assert {r["target"] for r in mixing.mix(df.withColumn("text", F.lit(""))).collect()} == {0.0}


def test_sharding(spark, edge, documents):
    docs = [(d["doc_id"], d["text"]) for d in documents] + [(1000 + i, "copy of one text") for i in range(300)] + [(None, None), (5000, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for shards, options in ((40, {}), (3, {"piece_bytes": 2000}), (1, {})):
        placed = df.select("doc_id", "text", *[c.alias(n) for c, n in zip(sharding.keys(F.col("text"), F.col("doc_id")), ("h", "d"), strict=True)])
        rows = sharding.shard(placed, shards, **options).collect()
        size = lambda r: len((r["text"] or "").encode()) + 16
        total, before, slots = sum(map(size, rows)), 0, defaultdict(list)
        for r in sorted(rows, key=lambda r: (r["h"], r["d"])):
            assert r["shard"] == shards * before // total
            before += size(r)
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    near = Counter()
    for r in sharding.shard(df, 5, tolerance=0.2).collect():
        near[r["shard"]] += len((r["text"] or "").encode()) + 16
    assert max(near.values()) - min(near.values()) <= 0.8 * sum(near.values()) / 5


def test_sharding_query(spark, documents):
    for r in queries.QUERIES["op10_histogram_sharding"](spark, SF_DIR).collect():
        text = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "bytes", None)


def test_stored_writes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    kind = type(spark.conf)
    get = kind.get
    monkeypatch.setattr(kind, "get", lambda self, key, *default: str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *default))
    assert stored(spark.range(5)).count() == 5
    assert list(tmp_path.iterdir())


def test_row_numbers_outlast_another_split(spark, tmp_path, monkeypatch):
    """Files that later jobs pack into other partitions still give every row its own result."""
    item = "A train from the old station travels along the long river to the sea"
    kinds = ["plain words number {i} and more", "write to user{i}@mail.example.org today", item + " {i}", "one and the same text in all of the files"]
    for i in range(24):
        one = spark.createDataFrame([(10 * i + k, kinds[k].format(i=i) + " tail" * (i if k != 3 else 0)) for k in sorted({i % 3, i % 4})], "doc_id bigint, text string")
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    base = lambda d: pii.find(d).select("doc_id", pii.joined(F.col("base")))
    operators = {
        "decontaminate": lambda: decontaminate.contamination(docs, bench(spark, (item,))).select("doc_id", "contaminated"), "decontaminated": lambda: decontaminate.decontaminated(docs, bench(spark, (item,))),
        "one of each": lambda: jaccard.one_of_each(docs), "jaccard": lambda: jaccard.jaccard_groups(docs), "pii": lambda: base(docs), "tokens": lambda: tokencount.count_tokens(docs, BPE, common=1),
    }
    want = {k: Counter(map(tuple, f().collect())) for k, f in operators.items()}
    sizes = ["1k", "128m"]

    def flipping(real):
        def run(df):
            out = real(df)
            sizes.reverse()
            spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
            return out

        return run

    for module, name in ((decontaminate, "cut_lineage"), (jaccard, "stored"), (pii, "stored"), (tokencount, "stored")):
        monkeypatch.setattr(module, name, flipping(getattr(module, name)))
    try:
        for k, f in operators.items():
            for start in ("1k", "128m"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", start)
                assert Counter(map(tuple, f().collect())) == want[k], k
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
