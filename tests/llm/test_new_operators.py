"""Token alignment, chat formatting and collocations on edge cases, and against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from demandloom.llm import alignment, chatformat, collocation
from tests.llm import brute
from tests.llm.brute import SF_DIR

PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))
ODD = ["▁ low line", "a▁b", "<s> x </s> <0x41> <unk>", "日本語 текст 🙂🙂 ́", "\x00nul", "1" * 3000, "y" * 5000, "\r\n\t tabs\t\t", "<|endoftext|>", " lead and trail "]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(*PATHS)


def aligned_by_hand(texts):
    """Per text (n_a, n_b, groups as id lists, links as id pairs) with the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), alignment.byte_letters()
    a.encode_special_tokens = True
    out = []
    for t in texts:
        want = (" " + (t or "")).encode()
        e = a.encode(want.decode(), add_special_tokens=False)
        x = [(i, bytes(letters[c] for c in s)) for i, s in zip(e.ids, e.tokens, strict=True)]
        y = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(t or "") for p in [b.id_to_piece(i)]]
        if not t or b"".join(s for _, s in x) != want or b"".join(s for _, s in y) != want:
            out.append((0, 0, [], []))
            continue
        groups, i, j, p, q = [([], [])], 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if p <= q and i < len(x):
                groups[-1][0].append(x[i][0])
                p, i = p + len(x[i][1]), i + 1
            else:
                groups[-1][1].append(y[j][0])
                q, j = q + len(y[j][1]), j + 1
            if p == q and p < len(want):
                groups.append(([], []))
        out.append((len(x), len(y), groups, [(u, v) for g in groups for u in g[0] for v in g[1]]))
    return out


def alignment_rows(texts):
    made = aligned_by_hand(texts)
    held = Counter(pair for *_, links in made for pair in set(links))
    best = defaultdict(int)
    for (u, _), n in held.items():
        best[u] = max(best[u], n)
    written = [";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups) for _, _, groups, _ in made]
    return [(a, b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), text) for (a, b, groups, links), text in zip(made, written, strict=True)]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_alignment(spark, edge_rows, documents, frequent):
    texts = [d["text"] for d in documents[:80]] + [r[1] for r in edge_rows] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in alignment.align(df, PATHS, 32000, frequent=frequent).collect()}
    for i, want in enumerate(alignment_rows(texts)):
        assert got[i] == want, texts[i]


def test_alignment_edges(spark, edge, empty, edge_rows):
    assert Counter(r["doc_id"] for r in alignment.align(edge, PATHS, 32000, digest=True).collect()) == Counter(r[0] for r in edge_rows)
    assert alignment.align(empty, PATHS, 32000).count() == 0


def test_fast_ranks_give_the_library_tokens(both):
    slow = alignment.Tokenizers(*PATHS[:2])
    random.seed(5)
    texts = ["".join(random.choices("aZé ñ09 .,'’-\n\t\"sdtll€\x07", k=random.randint(1, 60))) for _ in range(3000)]
    assert both.fast is not None and slow.fast is None
    assert both.encode(texts) == slow.encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_overlap_links(both, texts):
    texts = [t for t in texts if t.isprintable()]
    for row, t in zip(alignment.aligned_texts(both, texts, "overlap"), texts, strict=True):
        (a,), (b,) = both.encode([t])
        at = lambda ids, table: [i for k, i in enumerate(ids) for _ in table[i] for i in [k]]
        shared = {(x, y) for x, y in zip(at(a, both.a_bytes), at(b, both.b_bytes), strict=True)}
        want = Counter(a[x] * both.b_size + b[y] for x, y in shared)
        assert dict(zip(row["keys"].tolist(), row["ways"].tolist(), strict=True)) == want


def test_csr_products_in_runs(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, (9, 7)), rng.integers(0, 3, (7, 11))
    csr = lambda m: alignment.Csr.incidence(*(np.repeat(i, m.ravel()) for i in np.indices(m.shape).reshape(2, -1)), *m.shape)
    for size in (alignment.EXPANDED, 1):
        monkeypatch.setattr(alignment, "EXPANDED", size)
        made = csr(x).times(csr(y))
        dense = np.zeros((9, 11), int)
        dense[made.rows(), made.columns] = made.values
        assert (dense == x @ y).all()


CHAT = "conv_id bigint, turn bigint, role string, text string, part string, loss string"


def chat_rows(turns):
    """``turns``: (conv_id, turn, role, text) in the order they must come."""
    out = defaultdict(lambda: [0, "", "", 0])
    for c, _, role, text in turns:
        row, role, text = out[c], role or "", text or ""
        escaped = lambda s, more="": re.sub(rf"\\|{more}### |</turn>", lambda m: "\\" + m[0], s)
        row[0] += 1
        row[1] += f"{role}\n{text}\n"
        row[2] += text if role == "assistant" else ""
        row[3] += len(f"### {escaped(role, ':|')}: {escaped(text)}</turn>\n")
    return {c: (n, brute.sha(turns), len(loss), brute.sha(loss), chars) for c, (n, turns, loss, chars) in out.items()}


@pytest.mark.parametrize("rows", [chatformat.PIECE_ROWS, 2])
def test_chat_format(spark, monkeypatch, rows):
    random.seed(6)
    parts = ["### ", "</turn>", "\\", "\n", ": ", "assistant", "é🙂", "<", "/turn>", "#", " ", "x", "</turn", "##", "\x00"]
    said = lambda: random.choice([None, "", *["".join(random.choices(parts, k=random.randint(1, 9))) for _ in range(8)]])
    turns = [(c, t, random.choice(["user", "assistant", "assistant", "a:b", "### x: </turn>", "\\", None, ""]), said()) for c in range(120) for t in range(random.randint(1, 6))]
    turns += [(500, t, "assistant", f"turn {t} ") for t in range(3000)] + [(501, 0, "user", "long " * 50_000), (501, 1, "assistant", "é" * 90_000)]
    turns += [(None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    monkeypatch.setattr(chatformat, "PIECE_ROWS", rows)
    monkeypatch.setattr(chatformat, "SLICE_ROWS", 4 * rows)
    mixed = random.sample(turns, len(turns))
    df = spark.createDataFrame([(*t, "clash", "clash") for t in mixed], CHAT)
    made = chatformat.format_chats(df)
    assert {r[0]: tuple(r)[1:] for r in chatformat.digests(made).collect()} == chat_rows(turns)
    spread = made.where("conv_id = 500").count()
    assert spread > (300 if rows == 2 else 0)
    held = made.where("conv_id = 3 AND whole").collect()
    for r in held:
        assert [x for x in chatformat.turns_of(r["formatted"])] == [(role or "", text or "") for c, _, role, text in turns if c == 3]


def test_chat_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 5, "user", "b"), (1, None, "user", "first"), (1, 5, "user", "b"), (1, 5, "assistant", "a")], CHAT[: CHAT.index(", part")])
    (row,) = chatformat.digests(chatformat.format_chats(df)).collect()
    assert tuple(row)[1:] == chat_rows([(1, None, "user", "first"), (1, 5, "assistant", "a"), (1, 5, "user", "b"), (1, 5, "user", "b")])[1]
    assert chatformat.digests(chatformat.format_chats(df.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="#: </turn>\\ax\n", max_size=12), st.text(alphabet="#: </turn>\\ax\n", max_size=30)), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    roles, texts = (pa.array([t[i] for t in turns], pa.string()) for i in (0, 1))
    formatted, loss = chatformat.assembled(roles, texts, np.array([0]))
    assert list(chatformat.turns_of(formatted[0].as_py())) == turns and loss[0].as_py() == []


def collocation_rows(docs, least, top, most=5):
    """``docs``: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lower(text or "")):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(tuple(ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        scored, inside = [], defaultdict(int)
        for p, a in counts.items():
            if a >= least:
                for i in range(len(p)):
                    for j in range(i + 1, len(p) + 1):
                        if j - i < len(p):
                            inside[p[i:j]] = max(inside[p[i:j]], a)
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not inside[p] >= a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 12), (100, 2000)])
def test_collocations(spark, edge_rows, documents, least, top):
    docs = [(d["text"], d["lang"]) for d in documents[:120]] + [(r[1], r[2]) for r in edge_rows]
    docs += [("New\tYork  CITY, new york city! strange\x00 new york", x) for x in ("en", "und", None, "EN") for _ in range(6)]
    df = spark.createDataFrame(docs, "text string, lang string")
    got = collocation.collocations(df, least=least, top=top).collect()
    assert sorted(map(tuple, got)) == collocation_rows(docs, least, top)


def test_collocations_of_nothing(spark, empty):
    assert collocation.collocations(empty, lang="source").count() == 0
    assert collocation.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), least=1).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=30), min_size=1, max_size=12), st.integers(1, 40))
def test_summaries_lose_nothing_frequent(parts, least):
    """However the parts are merged, a key of weight ``least`` survives, and counts are off by ``lost`` at most."""
    columns = lambda rows: [np.array(x, np.int64) for x in zip(*rows, strict=True)]
    true = Counter()
    one, halves = collocation.Summary(least, 1), [collocation.Summary(least, 1) for _ in range(2)]
    for i, rows in enumerate(parts):
        for k, n in rows:
            true[k] += n
        one.merge(*columns(rows))
        halves[i % 2].merge(*columns(rows))
    assert one.lost < least
    assert {k for k, n in true.items() if n >= least} <= set(one.survivors().tolist())
    assert all(c <= true[k] <= c + one.lost for k, c in zip(one.keys.tolist(), one.counts.tolist(), strict=True))
    halves[0].merge(halves[1].keys, halves[1].counts, halves[1].lost)
    assert {k for k, n in true.items() if n >= least} <= set(halves[0].survivors().tolist())


def test_counted_rows_do_not_grow_with_the_parts_of_the_input(spark, monkeypatch):
    """A phrase found in every part of the input is given out a few times per core, not once per part."""
    words = [f"w{i}" for i in range(30)]
    rows = spark.createDataFrame([(" ".join(words), "en")] * 800, "text string, lang string")
    everything = spark.sparkContext.broadcast(np.full(collocation.FILTER_BITS // 64, 2**64 - 1, np.uint64))
    plain, seen = type(rows).mapInArrow, []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **b: seen.append(plain(self, *a, **b)) or seen[-1])
    totals = collocation.exact_counts(rows.repartition(20 * spark.sparkContext.defaultParallelism), [everything] * 3, 2)
    assert {tuple(r) for r in totals.collect()} == {("en", n, " ".join(words[i : i + n]), 800) for n in (1, 2) for i in range(31 - n)}
    assert seen[0].count() <= 2 * spark.sparkContext.defaultParallelism * 59


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.text(alphabet="ab ,\t", max_size=12), min_size=1, max_size=4), st.integers(-1, 4)), min_size=1, max_size=6))
def test_held_counts_are_given_out_whole(groups):
    """Whatever is given out on the way, the counts of a phrase add up."""
    held, got, true, batches = collocation.Held(), Counter(), Counter(), []
    for texts, up_to in groups:
        block = collocation.Block(texts, ["en", None][: len(texts)] + ["en"] * (len(texts) - 2), {})
        for n in (1, 2):
            first, hashes = block.grams(n)
            true.update((block.names[block.lang[i]], n, block.phrase(i, n)) for i in first)
            held.add(block, n, first, hashes)
        batches += held.taken(up_to)
        assert (held.counts > up_to).all()
    batches += held.taken(int(held.counts.max(initial=0)))
    for b in batches:
        for r in b.to_pylist():
            got[r["lang"], r["size"], r["phrase"]] += r["n"]
    assert got == true and not len(held.keys)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = "one two, three four five. " * 50 + "six " * 100 + "; seven eight"
    batch = pa.RecordBatch.from_pydict({"text": [text], "lang": ["en"]})
    grams = lambda: Counter(b.phrase(i, n) for b in collocation.blocks([batch]) for n in (1, 2, 5) for i in b.grams(n)[0])
    whole = grams()
    monkeypatch.setattr(collocation, "BLOCK_BYTES", 40)
    assert len(list(collocation.blocks([batch]))) > 20 and grams() == whole


def test_queries_give_their_columns(spark):
    from demandloom.llm.queries import QUERIES

    chats = QUERIES["op12_chat_format"](spark, SF_DIR)
    said = "\\### Assistant: </turn> ok"
    assert [tuple(r)[1:] for r in chats.where("conv_id = -7").collect()] == [chat_rows([(-7, 0, "user", said), (-7, 1, "assistant", said)])[-7]]
    assert QUERIES["op11_token_alignment"](spark, SF_DIR).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
