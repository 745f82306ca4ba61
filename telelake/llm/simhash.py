"""SimHash near-duplicates.

Method: byte-position inverted index with count filtering. A fingerprint of 64 bits has
eight positional bytes. Two fingerprints at three or fewer differing bits share at least
five of them, so postings of positional bytes lead to every such pair: of any five of the
eight positions at least three lie in the same half, and each half has four triples of
positions, so eight postings of three bytes each reach every pair. Fingerprints that meet
in a posting are compared: the positional bytes they share are counted, pairs below five
are dropped, the rest is verified bit by bit.

Equal texts are one fingerprint from the start. Inside a posting only a spanning forest of
the links found leaves the task, so a dense group of near copies gives as many rows as it
has members. A posting that holds more than ``HEAVY`` fingerprints is dealt out again by
two more shared bytes, which a pair that shares five must have; no pair is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from telelake.llm.components import connected
from telelake.llm.rows import add_struct, arrow_step, fresh, store, struct_array, texts_of

BITS = 3
SEED = 42
SHINGLE = 3
# Shared positional bytes that a pair at BITS or fewer differing bits has at least.
MATCHES = 8 - BITS
TRIPLES = [half for base in (0, 4) for half in itertools.combinations(range(base, base + 4), 3)]
# Fingerprints of one posting that are compared directly.
HEAVY = 4096
# Fingerprints of one posting of the second level that are compared directly; in larger
# ones each asks for its neighbours.
ASKED = 8192
# Shingles counted at a time, for texts of any length.
CHUNK = 1 << 14
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

FINGERPRINT = StructType([StructField("value", LongType(), False)])
FOUND = StructType(
    [
        StructField("a", LongType(), False),
        StructField("b", LongType(), False),
        StructField("slot", LongType(), False),
        StructField("heavy", BooleanType(), False),
    ]
)


def fingerprint(text: str | None, seed: int = SEED, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint; a bit is 1 if set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    total, ones = 0, np.zeros(64, np.int64)
    while chunk := list(itertools.islice(shingles, CHUNK)):
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in chunk], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(chunk)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash") -> DataFrame:
    """Add ``out``: struct with ``value``, the fingerprint as a signed 64-bit number.

    A null text counts as empty; without a word the fingerprint is zero.
    """

    def make():
        def work(texts: pa.Array) -> pa.StructArray:
            values = np.array([fingerprint(t) for t in texts_of(texts)], np.uint64)
            return struct_array(FINGERPRINT, values.view(np.int64))

        return work

    return add_struct(docs, out, FINGERPRINT, [text], make)


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(0xFF)


def _posting(value: Column, positions: tuple[int, ...], slot: int) -> Column:
    """Number of the posting: slot and shared bytes."""
    key = F.lit(slot).cast("long")
    for p in positions:
        key = key * 256 + _byte(value, p)
    return key


def _dealt(postings: DataFrame, heavy_limit: int | None) -> DataFrame:
    """Links inside each posting; ``postings`` has (value, slot, key)."""
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = postings.repartition(tasks, "key").sortWithinPartitions("key", "value")
    return arrow_step(ordered.select("key", "value", "slot"), _compare(heavy_limit), FOUND)


def _compare(heavy_limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches of a posting wait until it ends, and are put together once.
        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            if not len(new[0]):
                continue
            if waiting and waiting[0][0][0] == new[0][-1]:
                waiting.append(new)
                continue
            # The last posting may go on in the next batch.
            end = int(np.searchsorted(new[0], new[0][-1]))
            done = [*waiting, [n[:end] for n in new]]
            if sum(len(d[0]) for d in done):
                yield from _links(*map(np.concatenate, zip(*done, strict=True)), heavy_limit)
            waiting = [[n[end:] for n in new]]
        if waiting:
            yield from _links(*map(np.concatenate, zip(*waiting, strict=True)), heavy_limit)

    return run


def _near(values: np.ndarray, forest: _Forest) -> None:
    """Links in a large posting of the second level, by asking for every value within ``BITS`` bits.

    Five bytes are the same in the whole posting, so three are left: a table of 2^24 bits
    says which values there are, and each value is asked for its 2,324 neighbours, instead of
    being compared with all others.
    """
    unsigned = values.view(np.uint64)
    by_byte = unsigned.view(np.uint8).reshape(-1, 8)
    free = [i for i in range(8) if (by_byte[:, i] != by_byte[0, i]).any()]
    index = sum(by_byte[:, i].astype(np.int64) << 8 * k for k, i in enumerate(free))
    place = np.full(1 << 8 * len(free), -1, np.int32)
    place[index] = np.arange(len(values))
    flips = [1 << b for b in range(8 * len(free))]
    for count in range(1, BITS + 1):
        for chosen in itertools.combinations(flips, count):
            other = place[index ^ sum(chosen)]
            pairs = np.flatnonzero(other > np.arange(len(values)))
            forest.add(values[pairs], values[other[pairs]])


def _links(keys: np.ndarray, values: np.ndarray, slots: np.ndarray, heavy_limit: int | None) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    unsigned = values.view(np.uint64)
    if heavy_limit:
        for start, size in zip(starts[sizes > heavy_limit], sizes[sizes > heavy_limit], strict=True):
            own = values[start : start + size]
            yield _found(own, own, slots[start : start + size], True)
        light = np.repeat(sizes <= heavy_limit, sizes)
    else:
        light = np.repeat(sizes <= ASKED, sizes)
    forest = _Forest()
    if not heavy_limit:
        for start, size in zip(starts[sizes > ASKED], sizes[sizes > ASKED], strict=True):
            _near(np.unique(values[start : start + size]), forest)
    # Rows at growing distance in the same posting; the rows that still have one get few.
    last = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(light & (np.arange(len(keys)) + 1 < last))
    step = 1
    while len(at):
        left, right = unsigned[at], unsigned[at + step]
        differing = left ^ right
        shared = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = (shared >= MATCHES) & (np.bitwise_count(differing) <= BITS)
        forest.add(values[at[near]], values[at[near] + step])
        step += 1
        at = at[at + step < last[at]]
    a, b = forest.links()
    if len(a):
        yield _found(a, b, np.zeros(len(a), np.int64), False)


def _found(a: np.ndarray, b: np.ndarray, slots: np.ndarray, heavy: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(slots), pa.array(np.full(len(a), heavy))], names=FOUND.names
    )


class _Forest:
    """Union-find over the fingerprints that have a link; keeps each link that joins two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.kept.append((a, b))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.array(self.kept, np.int64)
        return pairs[:, 0], pairs[:, 1]


def links(values: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Rows (a, b) whose components are those of all pairs at ``BITS`` or fewer bits.

    ``values`` has distinct fingerprints in the column ``value``.
    """
    value = F.col("value")
    keys = [
        F.struct(F.lit(i).cast("long").alias("slot"), _posting(value, p, i).alias("key")) for i, p in enumerate(TRIPLES)
    ]
    postings = values.select("value", F.inline(F.array(*keys)))
    first = store(_dealt(postings, heavy), "simhash-links")
    found = first.where("not heavy").select("a", "b")
    crowded = first.where("heavy").select(F.col("a").alias("value"), "slot")
    if crowded.isEmpty():
        return found
    deeper = []
    for i, triple in enumerate(TRIPLES):
        others = [p for p in range(8) if p not in triple]
        for j, pair in enumerate(itertools.combinations(others, 2)):
            deeper.append((i, _posting(value, (*triple, *pair), 16 * i + j)))
    again = crowded.select(
        "value",
        "slot",
        F.explode(F.array_compact(F.array(*[F.when(F.col("slot") == i, k) for i, k in deeper]))).alias("key"),
    )
    second = _dealt(again.select("value", "slot", "key"), None)
    return found.unionByName(second.select("a", "b"))


def classes(values: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Rows (value, root) for the fingerprints that link with another one."""
    return connected(links(values, heavy), "a", "b").select(F.col("node").alias("value"), "root")


def _marked(docs: DataFrame, text: str, doc_id: str, columns: list[str], heavy: int) -> tuple[DataFrame, str]:
    """Rows of ``columns`` with helper columns: value, root, id and component."""
    mark = fresh("simhash")
    rows = fingerprints(docs, text, mark).select(
        *[F.col(f"`{c}`") for c in columns],
        F.col(f"{mark}.value").alias(f"{mark}_value"),
        F.col(f"`{doc_id}`").alias(f"{mark}_id"),
    )
    # The texts are hashed once; what follows reads the written marks.
    rows = store(rows, "simhash")
    seen = rows.groupBy(F.col(f"{mark}_value").alias("value")).agg(F.min(f"{mark}_id").alias("least"))
    seen = store(seen, "simhash-values")
    joined = seen.join(classes(seen.select("value"), heavy), "value", "left")
    joined = joined.withColumn("root", F.coalesce("root", "value"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    known = joined.join(least, "root").select(
        F.col("value").alias(f"{mark}_value"),
        F.col("root").alias(f"{mark}_root"),
        F.col("component").alias(f"{mark}_component"),
    )
    return rows.join(known, f"{mark}_value"), mark


def group(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    out: str = "near",
    columns: list[str] | None = None,
    heavy: int = HEAVY,
) -> DataFrame:
    """``columns`` (all by default) and ``out``: struct of ``fingerprint`` and ``component_id``.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest doc_id reachable by
    links. Rows without a doc_id link like others but name no component, so a component of
    such rows alone has a null id. Null texts count as empty, empty texts link with each
    other, and a repeated row is a member like any other. An empty table stays empty.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() != out.lower()]
    rows, mark = _marked(docs, text, doc_id, kept, heavy)
    shown = F.lpad(F.lower(F.hex(f"{mark}_value")), 16, "0")
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.struct(shown.alias("fingerprint"), F.col(f"{mark}_component").alias("component_id")).alias(out),
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs``, one of each component: the row of smallest doc_id.

    Of rows that agree in component and doc_id one stays, and so of a component without
    any doc_id. Everything else is as in ``group``.
    """
    rows, mark = _marked(docs, text, doc_id, docs.columns, heavy)
    first = rows.where(F.col(f"{mark}_id").eqNullSafe(F.col(f"{mark}_component")))
    repeated = first.groupBy(f"{mark}_root").count().where("count > 1")
    if not repeated.isEmpty():
        first = first.dropDuplicates([f"{mark}_root"])
    return first.select(*[F.col(f"`{c}`") for c in docs.columns])
