import pyarrow.parquet as pq
import pytest

from tests.llm.brute import SF_DIR

SCHEMA = "doc_id bigint, text string, source string, row_ string, at string, size string, shard string, kept string, spans string, items string, target string, n string, url string"
TEXTS = [
    None, "", "   ", "\n", "\n\n \t\n", "word", "two words", "A b c d", "a B c d", "a b c d e f g", "a b c d e f g",
    "x " * 30_000, "y" * 120_000, "1" * 30_000, "a@" * 5_000, "ünï \x0bcode\x0c   　 ‘quoted’ 🙂 ՘ ࢏",
    "ctrl \x01mark\x02 me@x.org \x03", "<|endoftext|> a<|endoftext|><|endoftext|>b  <|endoftext|>\n", "line\nline\n LINE \nother",
    "mail a.b@c.de,x@y.z1.w2 d@e ip 1.2.3.4 256.1.1.1 1.2.3.4.5 007.008.009.010 card 4111 1111 1111 1111 4111111111111112 tel +49 (30) 123-4567 +1",
]


@pytest.fixture(scope="session")
def documents():
    return pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows, repeated and missing ids."""
    rows = [(i, t, [None, "a", "b"][i % 3]) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all here", "a"), (None, "no id at all here", "a"), (3, "same id, other text", None), (9, TEXTS[9], "a"), (9, TEXTS[9], "a")]
    return [(*r, *["clash"] * 10) for r in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The edge rows with columns whose names the operators use themselves."""
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
