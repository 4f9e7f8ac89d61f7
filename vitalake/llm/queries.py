"""One query per operator over its whole table, with production parameters, beside its SQL where SQL can state it."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from vitalake.llm import centroids, decontaminate, language, lines, neardup, packing, prefixes, quality, revisits, secrets, substrings, suffixes, toxicity

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, sent to Python in small batches, as texts are long.

    Python workers are told where this package lies, for sessions started elsewhere.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file, as installed beside the libraries on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents")).drop("kept_text")


def minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "documents"), size=4)


def warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return revisits.digest(revisits.resolve(revisits.captures(table(spark, folder, "pages"))))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, table(spark, folder, "benchmark")))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.rate(docs, quality.train(docs, table(spark, folder, "labels"))).drop("text")


def maxent_lm(spark: SparkSession, folder: str) -> DataFrame:
    return language.score(table(spark, folder, "documents"))


def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("kept")


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text")))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(table(spark, folder, "conversations"))


def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.digest(centroids.cluster(table(spark, folder, "embeddings")))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.digest(lines.remove_repeats(table(spark, folder, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup,
    "op2_minhash_dedup": minhash_dedup,
    "op3_warc_revisits": warc_revisits,
    "op4_decontamination": decontamination,
    "op5_quality_rules": quality_rules,
    "op6_maxent_lm": maxent_lm,
    "op7_suffix_dedup": suffix_dedup,
    "op8_secret_scan": secret_scan,
    "op9_packing": packed,
    "op10_toxicity": toxic,
    "op11_prefix_trie": prefix_trie,
    "op12_centroid_clusters": centroid_clusters,
    "op13_line_dedup": line_dedup,
}
SQL: dict[str, str] = {
    "op3_warc_revisits": revisits.SQL,
    "op11_prefix_trie": prefix_trie,
    "op11_prefix_trie": prefixes.SQL,
    "op12_centroid_clusters": centroids.SQL,
    "op13_line_dedup": lines.SQL,
}
