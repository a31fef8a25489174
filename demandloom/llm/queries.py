"""The operators over the given tables, one query each, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import alignment, chatformat, collocation, decontaminate, jaccard, linededup, mixing, pii, quality, sharding, sql, tokencount, toxicity, urlfilter
from demandloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, toxicity.categories_of(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", mixing.size_in_words(docs.text).alias("size"))
    mixed = mixing.mix(docs, size=docs["size"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs.text, F.lit(""))
    h, d = sharding.keys(docs.text, docs.doc_id)
    docs = docs.select("doc_id", (F.octet_length(text) + sharding.ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"), d.alias("d"))
    done = sharding.shard(docs, size=docs["size"], key=(docs["h"], docs["d"]))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "items")


def op2_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: path of the vocabulary file; by default that of the installed package."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokenizer)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: tuple[str, ...] | None = None) -> DataFrame:
    """``tokenizers``: paths of byte-level file, piece model and ranks file; by default those of the installed package."""
    if tokenizers is None:
        import public_tokenizers

        tokenizers = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = alignment.align(docs, tokenizers, alignment.Tokenizers(*tokenizers).b_size, digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], talks.schema)
    done = chatformat.digests(chatformat.format_chats(talks.unionByName(more)))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_template_decontamination, op2_token_counts, op3_toxicity, op4_jaccard_join, op5_pii, op6_quality_rules, op7_line_dedup, op8_url_filter, op9_source_mixing, op10_histogram_sharding, op11_token_alignment, op12_chat_format, op13_collocations)}
_STOP = ", ".join(f"'{w}'" for w in sorted({w for line in quality.STOP_WORDS.values() for w in line.split()}))
#: Trained models, linked groups, span positions, token pieces and the CRC are out of reach of SQL.
ORACLES: dict[str, str] = {"op6_quality_rules": sql.OP6.replace("{stop}", _STOP), "op7_line_dedup": sql.OP7, "op9_source_mixing": sql.OP9, "op13_collocations": sql.OP13}
