"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method: hierarchical residual packing. Each task packs its own rows best-fit decreasing.
Bins that are nearly full leave at once; underfull bins go up a tree: they are dealt to
fewer tasks and packed again, each bin as one item, until one task holds the rest or a
round no longer saves a bin. Between rounds the bins are a written table.

A bin carries its members as a list, bounded by the capacity. A task of an upper round
gets about ``ROUND_ITEMS`` bins at any size of the input; the tree only gets higher.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from telelake.llm.bpe import Encoder
from telelake.llm.rows import arrow_step, groups, store, texts_of

CAPACITY = 4096
# Items that a task packs together in the first round; more are packed in several lots.
LOCAL_ITEMS = 200_000
# Underfull bins of one task in a later round.
ROUND_ITEMS = 50_000
# Bins with no more than this share of the capacity left count as nearly full.
NEARLY = 1 / 256


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the items in order of their bins, and the bin of each.

    Ties go to the earlier item. The open bins are kept by room; the set of rooms in use
    is one integer whose bits are searched for the smallest room that suffices.
    """
    order = np.argsort(-sizes, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, used = 0, [0] * len(sizes), 0
    for at, size in enumerate(sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, number, used = capacity, used, used + 1
        bins[at] = number
        if left := room - size:
            open_bins[left].append(number)
            rooms |= 1 << left
    by_bin = np.argsort(np.array(bins, np.int64), kind="stable")
    return order[by_bin], np.array(bins, np.int64)[by_bin]


def pack(
    items: DataFrame,
    length: str,
    capacity: int = CAPACITY,
    sequence: str = "sequence_id",
    offset: str = "offset",
) -> DataFrame:
    """Pack the rows of ``items`` by their ``length``; adds ``sequence`` and ``offset``.

    Lengths must be between 1 and ``capacity``; a length outside, or null, is an error,
    because such a row has no place. Repeated rows are packed each for itself, ties are
    broken by the order of rows inside a task, an empty table gives an empty result.
    Columns named like the two results are replaced.
    """
    results = {sequence.lower(), offset.lower()}
    items = items.drop(*[c for c in items.columns if c.lower() in results])
    names = items.columns
    renamed = items.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    at = f"_c{names.index(length)}"
    member = renamed.schema
    schema = StructType(
        [StructField("fill", IntegerType(), False), StructField("members", ArrayType(member, False), False)]
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LOCAL_ITEMS:
                yield from _packed(_rows(held), at, capacity)
                held = []
        if held:
            yield from _packed(_rows(held), at, capacity)

    limit = capacity - int(capacity * NEARLY)
    bins = store(arrow_step(renamed, local, schema), "bins")
    done: list[DataFrame] = []
    before = None
    while True:
        under = bins.where(F.col("fill") < limit)
        count = under.count()
        tasks = -(-count // ROUND_ITEMS)
        if count < 2 or before is not None and count >= before:
            done.append(bins)
            break
        done.append(bins.where(F.col("fill") >= limit))
        before = count
        # Dealt by content, so that a repeated task sees the same rows.
        key = F.xxhash64(F.col("fill"), F.to_json(F.element_at("members", 1)))
        dealt = under.repartition(tasks, key).sortWithinPartitions(F.desc("fill"), key)
        bins = store(arrow_step(dealt, _merge(capacity), schema), "bins")
        if tasks == 1:
            done.append(bins)
            break
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    final = StructType(
        [*member.fields, StructField("sequence", LongType(), False), StructField("offset", LongType(), False)]
    )
    numbered = whole.select(F.monotonically_increasing_id().alias("sequence"), "members")
    return arrow_step(numbered, _laid_out(at), final).toDF(*names, sequence, offset)


def _rows(held: list[pa.RecordBatch]) -> pa.StructArray:
    table = pa.Table.from_batches(held).combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
    return pa.StructArray.from_arrays(columns, fields=list(table.schema))


def _packed(rows: pa.StructArray, at: str, capacity: int) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    column = rows.field(at)
    sizes = column.to_numpy(zero_copy_only=False)
    if column.null_count or sizes.min() < 1 or sizes.max() > capacity:
        raise ValueError(f"lengths must be between 1 and {capacity}")
    order, bins = best_fit(sizes.astype(np.int64), capacity)
    starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    fills = np.add.reduceat(sizes[order].astype(np.int64), starts)
    offsets = np.r_[starts, len(rows)].astype(np.int32)
    yield _bins(fills, offsets, rows.take(pa.array(order)))


def _bins(fills: np.ndarray, offsets: np.ndarray, members: pa.StructArray) -> pa.RecordBatch:
    kind = pa.list_(pa.field("element", members.type, False))
    listed = pa.ListArray.from_arrays(pa.array(offsets), members).cast(kind)
    return pa.RecordBatch.from_arrays([pa.array(fills.astype(np.int32)), listed], names=["fill", "members"])


def _merge(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        fills = table.column("fill").to_numpy().astype(np.int64)
        lists = table.column("members").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        order, bins = best_fit(fills, capacity)
        lists = lists.take(pa.array(order))
        starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        inner = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        yield _bins(
            np.add.reduceat(fills[order], starts), inner[np.r_[starts, len(order)]].astype(np.int32), lists.flatten()
        )

    return run


def _laid_out(at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            members = lists.flatten()
            counts = np.diff(lists.offsets.to_numpy())
            sizes = members.field(at).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(sizes) - sizes
            first = np.repeat(np.cumsum(counts) - counts, counts)
            sequence = np.repeat(batch.column(0).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays(
                [*members.flatten(), pa.array(sequence), pa.array(before - before[first])],
                names=[*[f.name for f in members.type], "sequence", "offset"],
            )

    return run


PIECES = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("piece", IntegerType(), False),
        StructField("start", LongType(), False),
        StructField("length", LongType(), False),
        StructField("ids_crc32", LongType(), False),
    ]
)
PIECES_IDS = StructType([*PIECES.fields, StructField("ids", ArrayType(IntegerType(), False), False)])


def pieces(
    docs: DataFrame,
    path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    end: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Token pieces of every document: its ids and then ``end``, cut at ``capacity``.

    A null or empty text is the piece that holds ``end`` alone. Only documents of more
    than ``capacity`` ids are cut. A null ``doc_id`` stays null and ids keep their type, repeated rows
    give their pieces again, an empty table gives none. ``with_ids`` adds the ids themselves.
    """
    kind = docs.schema[doc_id].dataType
    schema = StructType([StructField("doc_id", kind), *(PIECES_IDS if with_ids else PIECES).fields[1:]])
    closing = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in groups(batch, "text"):
                ids = [b + closing for b in encoder.encode(texts_of(part.column("text")))]
                rows: list[tuple] = []
                for doc, raw in enumerate(ids):
                    for number, start in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[start : start + 4 * capacity]
                        rows.append((doc, number, start // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = [
                    pa.array(list(c), type=t)
                    for c, t in zip(
                        zip(*rows, strict=True),
                        [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()],
                        strict=True,
                    )
                ]
                columns[0] = part.column("doc_id").take(columns[0])
                if with_ids:
                    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    offsets = np.r_[0, np.cumsum([r[3] for r in rows])].astype(np.int32)
                    kind = pa.list_(pa.field("element", pa.int32(), False))
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(kind))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return arrow_step(chosen, run, schema)
