"""Registered queries of the corpus operators and, where SQL can say them, their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docrisk.llm import decontaminate, fingerprints, fm_dedup, license_scan, line_dedup, ngram_join, packing, prefix_trie, quality, repair, suffix_dedup, token_files, warc
from docrisk.llm.checks import SQL  # noqa: F401 - check SQL by query name
from docrisk.llm.common import source
from docrisk.session import tune


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(tune(spark), source(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(tune(spark), source(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(source(tune(spark), sf_dir, "documents"), source(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(source(tune(spark), sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(tune(spark), sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(source(tune(spark), sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(tune(spark), source(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(source(tune(spark), sf_dir, "documents"), source(spark, sf_dir, "labels"))


def op9_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.dedup(source(tune(spark), sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(source(tune(spark), sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(tune(spark), source(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reports(repair.damage(source(tune(spark), sf_dir, "conversations"))).drop("most_open")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(source(tune(spark), sf_dir, "conversations"), prefix_trie.SHARED, prefix_trie.MOST_SHARED)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_warc, op3_decontaminate, op4_suffix_dedup, op5_line_dedup, op6_ngram_join, op7_fingerprints, op8_quality, op9_fm_dedup, op10_license_scan,
    op11_token_files, op12_repair, op13_prefix_trie,
)}
