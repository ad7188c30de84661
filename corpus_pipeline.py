"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality and toxicity drop what they reject, near-duplicate removal keeps one document of each group, mixing takes the
documents of each source as often as its share asks, and encoding turns what is left into subword ids.

Null texts are empty ones; null ids and sources are values like any other, but that rows with a null id are in no group of
near-duplicates. Repeated rows are one group. Further columns stay in all stages but the last, whatever their names. Empty
tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, neardup, pieces, quality, toxicity
from loomgraph.llm.common import named, scope, stage, table, unstage, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the ratings of these documents, doesn't take for junk."""
    grade, tail = unused("expected_grade", docs), unused("tail_probability", docs)
    scored = quality.classified(docs, table(spark, sf_dir, "labels"), all_columns=True, names=(grade, tail))
    return scored.filter(F.col(tail) >= quality.KEEP_LEAST).select(*map(named, docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model, fitted on the labels of these documents, doesn't find toxic."""
    score, count, spans = (unused(n, docs) for n in ("toxicity", "offending_count", "offending"))
    scored = toxicity.score_toxicity(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")), names=(score, count, spans))
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*map(named, docs.columns))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return neardup.deduplicated(docs).select(*map(named, docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs).select(*map(named, docs.columns))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, and digests of the ids and of the text that they decode to."""
    found = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["source"])
    return found.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("neardup", neardup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Fitted models, signatures and merges are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has read goes when it is done, but for what the last one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with scope() as keep:
            kept = keep(stage(step(spark, docs, sf_dir), name))
        unstage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
