"""The registered queries of the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voucherlens.llm import (
    chat, decontamination, filter_audit, fingerprints, jaccard, licenses, lines, packing, prefix_trie, quality,
    sentencepieces, suffixes, url_reputation,
)
from voucherlens.llm.url_reputation import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZERS = "/opt/tokenizers"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a checkout."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))


def tokenizer_path(name: str) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def query(name: str) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        return run

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_document_fingerprints")
def op1_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprint(read(spark, sf, "documents"))


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf, "documents"))


# Fixed values of the URL contract.
URL_RULES = [
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
]


@query("op3_url_reputation")
def op3_url_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that rules decide are the labelled outcomes of their hosts."""
    pages = read(spark, sf, "pages")
    outcomes = url_reputation.rule_outcomes(pages, URL_RULES)
    judged = url_reputation.judge(pages, outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffixes.cut_repeats(read(spark, sf, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("span_start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    built, _ = lines.dedup_lines(read(spark, sf, "documents"))
    return built.select(
        "row.doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


# Fixed value of the chat contract: a conversation that says control strings.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@query("op7_chat_formatting")
def op7_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    extra = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    extra = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns, tokenizer_path("byte_bpe_50k.json")))


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf, "documents")))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = quality.fit(documents, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.score(documents, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.decontaminate(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return decontamination.digest(found)


@query("op11_conversation_prefix_trie")
def op11_conversation_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt_turns(read(spark, sf, "conversations")))


@query("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepieces.encode(read(spark, sf, "documents"), model)
    return sentencepieces.digest(sentencepieces.decode(encoded, model))


@query("op13_filter_audit")
def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf, "documents"), read(spark, sf, "labels"))
