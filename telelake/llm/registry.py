"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telelake.llm import (
    ann,
    bpe,
    conversation_repair,
    html_extract,
    licenses,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    toxicity,
    warc,
)
from telelake.llm.rows import table

VOCABULARY = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), path), "length")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources of documents; a language is a path of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return quality_classifier.judge(docs, model, F.col("source"), F.col("lang"), columns=["doc_id"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "license.license",
        F.array_join("license.notices", ",").alias("notices"),
        F.size("license.notices").cast("long").alias("n_notices"),
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
    return found.select("page_id", "url", "main.*")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.group(docs, columns=["doc_id"]).select("doc_id", "near.fingerprint", "near.component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve(warc.records_of(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return resolved.select(
        "record_id",
        "canonical",
        "outcome",
        "refers_to",
        "payload_digest",
        F.array_join(F.array_sort(pairs), ";").alias("headers"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs).select("doc_id", "quality.*")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(table(spark, sf_dir, "conversations"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes_with_ends(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_bpe": op3_bpe,
    "op4_licenses": op4_licenses,
    "op5_html": op5_html,
    "op6_nearest": op6_nearest,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sharding": op12_sharding,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {"op4_licenses": licenses.sql(), "op9_warc": warc.SQL, "op12_sharding": sharding.sql()}
