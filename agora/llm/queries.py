"""Registered queries of this subpackage: one per dealt operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agora.llm import (bpe_chunks, chat, langid, lexical, main_text, packing, quality_rules, simhash, spelling,
                       suffix_dedup, syncmers, vector_graph, warc_audit)
from agora.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op9_chat_format", chat.oracle())
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_hostile(table(spark, sf_dir, "conversations"))
    return chat.chat_digests(chat.format_chats(rows))


@query("op3_simhash_dedup")
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@query("op4_pack")
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op1_langid")
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digests(bpe_chunks.encoded(table(spark, sf_dir, "documents")))


@query("op2_syncmers")
def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprinted(table(spark, sf_dir, "documents"))


@query("op10_main_text")
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(spark, sf_dir, "pages"))


@query("op8_vector_graph")
def op8_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_warc_audit", warc_audit.ORACLE)
def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_audit.audited(spark, sf_dir)


@query("op11_lexical", lexical.ORACLE)
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_quality_rules")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "failed")
