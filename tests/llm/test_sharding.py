"""Hash tree: the query against SQL, what a change of weights moves, slots, odd rows."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from telelake.llm import sharding as S
from telelake.llm.registry import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def shards(spark, leaves, keys=6000):
    rows = spark.range(keys).select("id", S.shard_of(F.col("id"), leaves).alias("shard"))
    return dict(map(tuple, rows.collect()))


def test_query_equals_sql(spark):
    assert difference(QUERIES["op12_sharding"](spark, SF), connect(SF), ORACLES["op12_sharding"]) is None


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for count in (24, 25, 30):
        before, after = shards(spark, S.layout(count)), shards(spark, S.layout(count + 1))
        assert {after[k] for k in after if after[k] != before[k]} == {count}
        sizes = Counter(after.values())
        assert set(sizes) == set(range(count + 1))
        mean = len(after) / (count + 1)
        assert max(abs(n - mean) for n in sizes.values()) < 5 * math.sqrt(mean)


def test_moves_stay_inside_the_subtrees_whose_weights_change(spark):
    leaves = S.layout(24)
    heavier = [leaf._replace(weight=3.0) if leaf.shard == 5 else leaf for leaf in leaves]
    before, after = shards(spark, leaves), shards(spark, heavier)
    place = {leaf.shard: leaf for leaf in leaves}
    moved = [(place[before[k]], place[after[k]]) for k in after if before[k] != after[k]]
    assert moved
    for old, new in moved:
        # Into the region that has grown; inside it into its rack; inside that into its shard.
        assert new.region == "r0"
        assert old.region != "r0" or new.rack == "k1"
        assert old.rack != "k1" or new.shard == 5
    share = Counter(after.values())[5] / len(after)
    assert abs(share - 3 / 26) < 0.02


def test_no_weight_no_rows(spark):
    leaves = [leaf._replace(weight=0.0) if leaf.shard == 7 else leaf for leaf in S.layout(24)]
    assert 7 not in shards(spark, leaves).values()


def test_slots_of_odd_rows(spark, tmp_path):
    docs = cases.documents(spark).unionByName(cases.documents(spark).where("doc_id = 1").crossJoin(spark.range(500)).drop("id"))
    docs = docs.withColumn("Slot", F.lit("mine"))
    for segments in (1, 7):
        placed = S.place(docs, "doc_id", S.layout(24), ["doc_id", "text"], segments)
        assert placed.columns == [*[c for c in docs.columns if c != "Slot"], "shard", "slot"]
        rows = placed.collect()
        assert len(rows) == docs.count()
        by = Counter(r.shard for r in rows)
        assert {(r.shard, r.slot) for r in rows} == {(s, n) for s in by for n in range(by[s])}
        assert all(len({r.shard for r in rows if r.doc_id == i}) == 1 for i in {r.doc_id for r in rows})
    assert S.place(cases.empty(spark), "doc_id", S.layout(24), ["doc_id"]).collect() == []
    S.write(placed, f"{tmp_path}/shards", rows_per_file=100)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)


def test_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = S.documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
