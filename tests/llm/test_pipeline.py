"""The pipeline against its stages done by hand on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from telelake.llm import quality_rules, simhash, toxicity
from telelake.llm.registry import held_out
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_rules.judge(docs).where("quality.kept").collect()}
    left = docs.where(F.col("doc_id").isin(*good))
    model = toxicity.fit(left, spark.read.parquet(f"{SF}/labels.parquet"), lambda i: ~held_out(i))
    clean = {r.doc_id: r.text for r in toxicity.score(left, model).where("toxicity.predicted = 0").collect()}
    values = {i: simhash.fingerprint(t) for i, t in clean.items()}
    label = {i: i for i in values}
    for _ in label:
        for i in values:
            for j in values:
                if (values[i] ^ values[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[i] == label[label[i]] for i in label):
            break
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(label.values())
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_stages_keep_the_columns(spark):
    for docs in (cases.documents(spark), cases.empty(spark)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            assert out.count() <= max(1, docs.count()) or number == len(corpus_pipeline.STAGES) - 1
