"""Documents to training sequences: quality rules, toxicity, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from telelake.llm import packing, quality_rules, simhash, toxicity
from telelake.llm.registry import VOCABULARY, held_out
from telelake.llm.rows import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; references come from ``docs`` itself."""
    judged = quality_rules.judge(docs, out="_quality")
    return judged.where("_quality.kept").select(*[f"`{c}`" for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from ``docs`` and labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    scored = toxicity.score(docs, model, out="_toxicity")
    return scored.where("_toxicity.predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(VOCABULARY)), "length")


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("packing", sequences),
]

# Hashing, training and packing have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = store(docs, f"pipeline-{name}")
    return docs
