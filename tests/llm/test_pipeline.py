"""The pipeline's stages against plain Python, each on what the stage before it kept."""

import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from demandloom.llm import mixing
from tests.llm import brute
from tests.llm.brute import SF_DIR

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, frames = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF_DIR).write.parquet(f"{out}/{i}")
        frames.append(spark.read.parquet(f"{out}/{i}"))
    return [[r.asDict() for r in f.collect()] for f in frames], frames


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    assert all(f.columns == COLUMNS for f in stages[1][:5]) and stages[1][5].columns == [*COLUMNS, "shard", "slot"]


def test_toxicity_keeps_what_is_labelled_clean(stages):
    before, after = stages[0][:2]
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}
    kept = set(ids(after))
    assert kept < set(ids(before))
    clean = [i for i, toxic in labels.items() if not toxic]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i not in kept for i, toxic in labels.items() if toxic) >= 0.5 * sum(labels.values())


def test_near_copies_leave_one_of_each_group(stages):
    before, after = stages[0][1:3]
    rows = sorted(before, key=lambda r: r["doc_id"])
    group, _ = brute.groups([r["text"] for r in rows], 5, 80)
    assert ids(after) == [r["doc_id"] for i, r in enumerate(rows) if group[i] == i]
    assert len(after) < len(before)


def test_benchmark_documents_go(stages):
    before, after = stages[0][2:4]
    plain = lambda t: " ".join(re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*", (t or "").lower()))
    items = [f" {plain(r['text'])} " for r in pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()]
    assert ids(after) == ids(r for r in before if not any(b in f" {plain(r['text'])} " for b in items))


def test_mix_repeats_and_drops(spark, stages):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stages[1][3]).collect()}
    assert Counter(ids(stages[0][4])) == Counter({i: n for i, n in copies.items() if n})
    assert set(copies.values()) >= {1, 2}


def test_shards_are_even_and_whole(stages):
    before, after = stages[0][4:6]
    assert ids(before) == ids(after)
    slots, size = defaultdict(list), Counter()
    for r in after:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += len((r["text"] or "").encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    largest = max(len((r["text"] or "").encode()) + 16 for r in after)
    assert max(size.values()) - min(size.values()) <= 3 * largest


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert Counter((r["doc_id"], r["shard"]) for r in out.collect()) == Counter((r["doc_id"], r["shard"]) for r in stages[0][5])
