"""The corpus pipeline: each stage reads what its predecessor wrote. Rows with a null doc_id pass the filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import bpe_reuse, components, decontaminate, pii, quality, similar, simhash
from tabulon.llm.common import saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects as of low quality or toxic."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each component of near copies. Texts are linked by SimHash, whose fingerprints within three bits the
    generalised pigeonhole principle finds; edited copies down to a Jaccard similarity of 0.8, of five-word shingles, differ by ten bits
    on average and are linked by their shingles as well."""
    return components.one_of_each(docs, "doc_id", [simhash.near_duplicates(docs).select("doc_id", "component"), similar.near_copies(docs)])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or with other values."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text; n_chars follows."""
    return pii.redacted(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and decoded text."""
    import public_tokenizers

    return bpe_reuse.encode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("bpe", bpe),
]

#: A trained classifier, a fingerprint graph and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
