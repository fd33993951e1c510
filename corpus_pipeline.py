"""The corpus pipeline: quality rules, near duplicates, secrets, source mix, packed windows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs; all but the last return the columns of ``documents``. Nulls, empty
texts and repeated rows are treated as each stage's operator says; empty documents end at the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import mixing, packing, quality, secrets, simhash
from quillgraph.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules or the perplexity bands of their own corpus reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that the forest accepts are masked in the texts."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them (not at all, or up to three times)."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens, with the checksum of their ids."""
    import public_tokenizers

    return packing.crc32s(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: The perplexity bands, the forest and the tokenizer have no SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
