"""SimHash, components and nearest neighbours against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from telelake.llm import ann, components, registry, simhash
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int]) -> list[int]:
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprints(spark):
    docs = cases.documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(50), allowMissingColumns=True)
    for row in simhash.fingerprints(docs).collect():
        assert row.simhash.value % (1 << 64) == plain_fingerprint(row.text)


def test_every_near_pair_meets_in_a_posting():
    rng = random.Random(1)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, 3))
        touched = {b // 8 for b in bits}
        assert any(not touched.intersection(t) for t in simhash.TRIPLES)


@pytest.mark.parametrize("heavy", [3, 50, 4096])
def test_links_keep_components(spark, heavy):
    rng = random.Random(heavy)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(40)}
    # A chain in which only neighbours link.
    chain, at = [], rng.getrandbits(64)
    for i in range(20):
        at ^= 7 << 3 * i
        chain.append(at)
    values = sorted(values | set(chain))
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "value long")
    roots = {r.value % (1 << 64): r.root for r in simhash.classes(frame, heavy).collect()}
    wanted = plain_components(values)
    groups: dict[int, list[int]] = {}
    for v, label in zip(values, wanted, strict=True):
        groups.setdefault(label, []).append(v)
    for members in groups.values():
        if len(members) == 1:
            assert members[0] not in roots
        else:
            assert len({roots[m] for m in members}) == 1
    assert len(set(roots.values())) == sum(len(m) > 1 for m in groups.values())


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, i) for i in range(5001, 5060)] + [(None, 3), (7, 7)]
    found = dict(components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    label = {x: x for e in edges for x in e if x is not None}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    alone = {7} - {x for a, b in edges if a != b for x in (a, b)}
    assert found == {k: v for k, v in label.items() if k not in alone and any(k in e and e[0] is not None and e[0] != e[1] for e in edges)}


def test_op8(spark):
    rows = registry.op8_simhash(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    ids = sorted(texts)
    values = [plain_fingerprint(texts[i]) for i in ids]
    wanted = dict(zip(ids, zip(values, plain_components(values), strict=True), strict=True))
    assert len(rows) == len(ids)
    for row in rows:
        value, label = wanted[row.doc_id]
        assert (row.fingerprint, row.component_id) == (f"{value:016x}", ids[label])


def test_simhash_edge_cases(spark):
    docs = cases.documents(spark)
    rows = simhash.group(docs, out="_out").collect()
    assert len(rows) == docs.count()
    near = {(r.doc_id, r.text): r["_out"] for r in rows}
    assert near[1, "The cat sat on the mat and looked at the moon."].component_id == 1
    assert near[2, "The cat sat on the mat and looked at the moon."].component_id == 1
    assert {near[k].component_id for k in near if not (k[1] or "").strip(" \t\n") and k[1] != " \t\n  "} == {3}
    assert near[None, "A row without a number that has words of its own."].component_id is None
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 1, 3, 5, 6, 7, 8]
    assert simhash.group(cases.empty(spark)).count() == simhash.one_of_each(cases.empty(spark)).count() == 0


def brute(ids, vectors, queries, k):
    found = {}
    lengths = np.linalg.norm(vectors, axis=1)
    for q in queries:
        scores = vectors @ vectors[q] / (lengths * lengths[q])
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if i != q][:k]
        found[q] = [(int(ids[i]), scores[i]) for i in order]
    return found


@pytest.mark.parametrize("small", [False, True])
def test_search_is_exact(spark, small):
    sf = "/root/testdata/sf0.01"
    settings = ann.Settings(window=8, block=16, packet_bytes=1 << 12, tile=7) if small else ann.Settings()
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    found: dict = {}
    for r in ann.search(frame, F.col("vec_id") % 50 == 0, settings=settings).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = frame.orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    wanted = brute(ids, vectors, np.flatnonzero(ids % 50 == 0), 5)
    assert len(found) == len(wanted)
    for q, near in wanted.items():
        got = sorted(found[ids[q]])
        assert [g[:2] for g in got] == [(i + 1, n[0]) for i, n in enumerate(near)]
        assert [g[2] for g in got] == pytest.approx([n[1] for n in near], abs=1e-12)


def test_no_copies_of_queries_are_broadcast(spark, tmp_path):
    """Tiles meet packets without a hash table, which would hold each query once for every packet."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), i % 9 == 0) for i, v in enumerate(rng.normal(size=(90, 8)))]
    spark.createDataFrame(rows, "class long, vector array<double>, asked boolean").write.parquet(str(tmp_path / "classes"))
    classes = spark.read.parquet(str(tmp_path / "classes"))
    bounds = classes.where("asked").select(F.col("class").alias("query"), "vector", F.lit(-2.0).alias("least"))
    more = ann.checked(classes, bounds, 3, ann.Settings(block=4, packet_bytes=256, tile=3))
    plan = more._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    found: dict = {}
    for r in more.collect():
        found.setdefault(r.query, []).append((r.near, r["class"]))
    vectors = np.array([v for _, v, _ in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    assert sorted(found) == list(range(0, 90, 9))
    for query, near in found.items():
        assert {c for _, c in sorted(near)[-4:]} == set(np.argsort(vectors @ vectors[query])[-4:].tolist())


def test_windows_alone_on_clusters(spark):
    """Where vectors cluster the curves alone reach a recall of 0.9."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 32))
    vectors = np.repeat(centres, 6, 0) + rng.normal(scale=0.05, size=(900, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    settings = ann.Settings(exact=False)
    found: dict = {}
    for r in ann.search(frame, F.col("vec_id") % 50 == 0, settings=settings).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    wanted = brute(np.arange(900), vectors, range(0, 900, 50), 5)
    assert np.mean([len(found[q] & {i for i, _ in near}) / 5 for q, near in wanted.items()]) >= 0.9


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_ties_of_many_vectors_go_to_the_smaller_ids(spark):
    rows = [(0, [1.0, 1.0, 0.0])] + [(i, [2.0**i, 0.0, 0.0]) for i in range(1, 61)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found: dict = {}
    for r in ann.search(frame, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [x[1] for x in sorted(found[0])] == [x[1] for x in sorted(found[50])] == [1, 2, 3, 4, 5]


def test_search_edge_cases(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, one), (1, one), (2, one), (3, two), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]),
            (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 0.0, 0.0]), (9, [1.0]), (10, []), (None, one),
            (50, [2.0, 0.0, 0.0]), (50, [2.0, 0.0, 0.0]), (100, [1e300, 1e-300, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, query string, rank string")
    found: dict = {}
    for r in ann.search(frame, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9) if np.isfinite(r.score) else None))
    assert [x[1] for x in sorted(found[0])] == [1, 2, 50, 50, 100]
    # The row of the same number is a candidate for each of the two rows.
    assert [x[1] for x in sorted(found[50])] == [0, 0, 1, 1, 2, 2, 50, 50, 100, 100]
    few = frame.where("vec_id in (0, 3)")
    assert [(r["rank"], r.vec_id, r.score) for r in ann.search(few, F.col("vec_id") == 0).collect()] == [(1, 3, 0.0)]
    assert ann.search(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(frame, F.lit(False)).count() == 0


def test_large_postings_ask_for_neighbours(monkeypatch):
    """The second level finds the same components by asking as by comparing."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 40, 3, dtype=np.uint64) << np.uint64(24)
    free = rng.integers(0, 1 << 9, 900, dtype=np.uint64) * np.uint64(0x8101)
    values = np.unique((base[rng.integers(0, 3, 900)] | (free & np.uint64(0xFFFFFF))).view(np.int64))
    keys = (values.view(np.uint64) >> np.uint64(24)).astype(np.int64)
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]

    def components(asked):
        monkeypatch.setattr(simhash, "ASKED", asked)
        label = {v: v for v in values.tolist()}
        def root(x):
            while label[x] != x:
                x = label[x]
            return x
        for batch in simhash._links(keys, values, np.zeros(len(keys), np.int64), None):
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                assert ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 3
                a, b = root(a), root(b)
                label[max(a, b)] = min(a, b)
        return {v: root(v) for v in label}

    assert components(4) == components(10**6)


def test_postings_over_many_batches():
    values = np.sort(np.random.default_rng(1).integers(0, 40, 600)).astype(np.int64)
    keys = np.repeat(np.array([5, 6, 9]), 200).astype(np.int64)
    def found(size):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (keys, values, np.zeros(600, np.int64))], names=["key", "value", "slot"])
            for i in range(0, 600, size)
        ]
        return sum(b.num_rows for b in simhash._compare(None)(iter(batches)))
    assert found(7) == found(200) == found(600) > 0
