"""BPE and packing against the tokenizers library and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from telelake.llm import bpe, packing, registry
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(seed: int, count: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = ["a", "e", "th", "ing", "S", "T", " ", "\n", "'s", "'LL", "1", "½", "é", "ß", "İ", "Σ", "́", "漢", "🙂",
                "<|endoftext|>", "<|", "|>", ".", "!!", "\x85", " ", "\x1c", "ǆ", "ﬁ", "K"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(count)]


def test_encoder_equals_library(library):
    texts = [*random_texts(1, 1500), "ab" * 5000, "<|ENDOFTEXT|>", "J̌", "W̊ x", cases.LONG[:5000]]
    for got, text in zip(bpe.Encoder(PATH).encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_cache_limit_changes_nothing():
    texts = random_texts(2, 300)
    small = bpe.Encoder(PATH, cache_words=10)
    assert [small.encode([t])[0] for t in texts] == bpe.Encoder(PATH).encode(texts)


def test_long_words_equal_short_ones():
    model, rng = bpe.WordBpe(PATH), random.Random(3)
    for _ in range(300):
        word = bytes(rng.choice(b"thenigrao") for _ in range(rng.randint(1, 30)))
        assert model.merge_long(word) == model.merge_short([word])[0]


def test_op3_digests(spark, library):
    rows = registry.op3_bpe(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_edge_cases(spark, library):
    docs = cases.documents(spark)
    rows = bpe.encode_decode(docs, PATH, out="_OUT").collect()
    assert len(rows) == docs.count()
    for row in rows:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert row["_OUT"].ids == ids
        assert row["_OUT"].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(cases.empty(spark), PATH).count() == 0


def check_packing(rows, capacity):
    bins: dict[int, list] = {}
    for row in rows:
        bins.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_op1_pieces(spark, library):
    rows = registry.op1_packing(spark, SF).collect()
    bins = check_packing(rows, 4096)
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1
    found: dict[int, list] = {}
    for row in rows:
        found.setdefault(row.doc_id, []).append(row)
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        own = sorted(found.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        for row in own:
            assert row.start == 4096 * row.piece
            cut = np.array(ids[row.start : row.start + row.length], "<u4")
            assert len(cut) == row.length and row.ids_crc32 == zlib.crc32(cut.tobytes())
        assert sum(r.length for r in own) == len(ids)
    assert not found


def test_best_fit_equals_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes, capacity = rng.integers(1, 30, rng.integers(1, 60)), 30
        order, bins = packing.best_fit(sizes, capacity)
        assert sorted(order.tolist()) == list(range(len(sizes)))
        rooms: list[int] = []
        for size in sorted(sizes.tolist(), reverse=True):
            fitting = [r for r in rooms if r >= size]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - size)
            else:
                rooms.append(capacity - size)
        fills = np.bincount(bins, sizes[order])
        assert sorted(fills.tolist()) == sorted(capacity - r for r in rooms)


@pytest.mark.parametrize("lot", [5, 100])
def test_tree_merges_underfull_bins(spark, monkeypatch, lot):
    monkeypatch.setattr(packing, "ROUND_ITEMS", lot)
    rows = spark.range(0, 200, 1, 40).selectExpr("id", "cast(1 + id * 7 % 40 as int) n", "'a' `Offset`")
    packed = packing.pack(rows, "n", 100).withColumnRenamed("n", "length")
    found = packed.collect()
    assert sorted(r.id for r in found) == list(range(200))
    least = -(-sum(r.length for r in found) // 100)
    assert least <= len(check_packing(found, 100)) <= least * (1.1 if lot == 100 else 1.4)


def test_items_that_never_share_a_bin(spark):
    rows = spark.range(50).selectExpr("id", "60 length")
    assert len(check_packing(packing.pack(rows, "length", 100).collect(), 100)) == 50


def test_packing_edge_cases(spark, library):
    docs = cases.documents(spark)
    rows = packing.pack(packing.pieces(docs, PATH, with_ids=True), "length").collect()
    check_packing(rows, 4096)
    assert sum(r.length for r in rows) == sum(
        len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()
    )
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(packing.pieces(cases.empty(spark), PATH), "length").count() == 0


def test_pieces_keep_the_type_of_ids(spark):
    docs = spark.createDataFrame([("a-1", "some words " * 9000), (None, None), ("b", "")], "doc_id string, text string")
    rows = packing.pieces(docs, PATH).collect()
    assert sorted((r.doc_id or "", r.piece) for r in rows) == [("", 0), *[("a-1", n) for n in range(len(rows) - 2)], ("b", 0)]
    assert len(rows) > 5
