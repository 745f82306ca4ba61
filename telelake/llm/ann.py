"""Nearest neighbours by cosine.

Method: shifted space-filling curves. Unit vectors are projected at random to a few
dimensions, shifted, and ordered along a Hilbert curve; this is done several times with
other projections and shifts. Each ordering is range-partitioned. A query takes the rows
within a window around its key on every curve; the windows merge and are reranked by the
exact cosine.

Vectors without structure have no good neighbours on any curve, so an exact check follows:
the cosine found so far bounds what can still matter, blocks of neighbouring keys carry a
centre and an angle, and a query compares with the blocks that may hold a nearer vector.
Where vectors cluster nearly all blocks are passed over. Results are exact at every size.

Equal vectors are one candidate that carries its smallest ids, so a vector that holds a
third of all rows is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from telelake.llm.rows import arrow_step, store


@dataclass(frozen=True)
class Settings:
    curves: int = 4
    # Projected dimensions and bits of each; their product is the length of a key.
    dimensions: int = 6
    bits: int = 10
    # Rows on either side of a query on each curve.
    window: int = 64
    # Rows of a block with one bound, and bytes of vectors that travel together.
    block: int = 128
    packet_bytes: int = 2 << 20
    # Queries that are compared with a packet at once.
    tile: int = 512
    seed: int = 11
    exact: bool = True


_SLACK = 1e-9
_FOUND = StructType(
    [StructField("query", LongType(), False), StructField("class", LongType(), False), StructField("near", DoubleType(), False)]
)
# Rows of packets are large: without these a reader holds a hundred of them at once.
_SMALL_GROUPS = {
    "parquet.block.size": 8 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
}


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers (each below 2**bits) along the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # From axes to the transposed curve index: undo the rotations level by level.
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            set_here = (x[i] & level) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_here, low, 0)
            x[0] ^= swap
            x[i] ^= swap if i else 0
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_key(unit: np.ndarray, curve: int, settings: Settings) -> np.ndarray:
    rng = np.random.default_rng([settings.seed, curve])
    directions = rng.normal(size=(unit.shape[1], settings.dimensions))
    shift = rng.uniform(0, 1, settings.dimensions)
    # Components of unit vectors are small; the logistic curve spreads them evenly.
    spread = 1 / (1 + np.exp(-1.7 * (unit @ directions)))
    cells = ((spread + shift) / 2 * (1 << settings.bits)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << settings.bits) - 1), settings.bits)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large and very small components do no harm.
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, all components finite numbers, not all zero."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """Rows (class, vector, ids, asked): each distinct vector with its k + 1 smallest ids.

    ``rows`` has the columns vec_id, vector and query.
    """
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    ids = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    listed = ids.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where("query").select("vector").distinct().withColumn("asked", F.lit(True))
    joined = listed.join(asked, "vector", "left").select(
        F.monotonically_increasing_id().alias("class"), "vector", "ids", F.coalesce("asked", F.lit(False)).alias("asked")
    )
    return store(joined, "ann-classes")


def _keyed(classes: DataFrame, curves: list[int], settings: Settings) -> DataFrame:
    """Classes in the order of each curve, range-partitioned."""
    schema = StructType(
        [StructField("curve", IntegerType(), False), StructField("key", LongType(), False), *classes.schema.fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("vector")))
                for curve in curves:
                    keys = curve_key(unit, curve, settings)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), curve, np.int32)), pa.array(keys), *batch.columns],
                        names=schema.names,
                    )

    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = arrow_step(classes, run, schema)
    return keyed.repartitionByRange(tasks, "curve", "key", "class").sortWithinPartitions("curve", "key", "class")


def best(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` largest scores and of all that tie with the last of them up to rounding."""
    if len(scores) <= count:
        return np.arange(len(scores))
    last = np.partition(scores, len(scores) - count)[len(scores) - count]
    return np.flatnonzero(scores >= last - _SLACK)


def windows(classes: DataFrame, k: int, settings: Settings) -> DataFrame:
    """Rows (query, class, near): the best of each window on each curve."""
    rows = _keyed(classes.select("class", "vector", "asked"), list(range(settings.curves)), settings)
    reach, count = settings.window, k + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve = np.empty(0, np.int64)
        number, unit, asked, done = np.empty(0, np.int64), None, np.empty(0, bool), 0
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = _unit(_matrix(batch.column("vector")))
                unit = new if unit is None else np.concatenate([unit, new])
                curve = np.r_[curve, batch.column("curve").to_numpy()]
                number = np.r_[number, batch.column("class").to_numpy()]
                asked = np.r_[asked, batch.column("asked").to_numpy(zero_copy_only=False)]
            if unit is None:
                return
            end = len(number) if batch is None else max(done, len(number) - reach)
            queries, seen, near = [], [], []
            for at in np.flatnonzero(asked[done:end]) + done:
                low, high = max(0, at - reach), min(len(number), at + reach + 1)
                inside = np.arange(low, high)[curve[low:high] == curve[at]]
                scores = unit[inside] @ unit[at]
                chosen = best(scores, count)
                queries.append(np.full(len(chosen), number[at]))
                seen.append(number[inside[chosen]])
                near.append(scores[chosen])
            if queries:
                yield _found(queries, seen, near)
            cut = max(0, end - reach)
            curve, number, unit, asked, done = curve[cut:], number[cut:], unit[cut:], asked[cut:], end - cut

    return arrow_step(rows.select("curve", "class", "vector", "asked"), search, _FOUND)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _found(queries: list, seen: list, near: list) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in (queries, seen, near)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_FOUND.names)


def _packets(rows: DataFrame, per_packet: int, label: str) -> DataFrame:
    """Columns of ``rows`` as bytes, ``per_packet`` rows in their order to a row; stored, a few MB to a row group.

    Vectors are scaled to length one, the other columns are numbers without nulls.
    """
    schema = StructType([StructField(c, BinaryType(), False) for c in rows.columns])

    def taken(column: pa.Array, name: str) -> bytes:
        return (_unit(_matrix(column)) if name == "vector" else column.to_numpy()).tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                for start in range(0, batch.num_rows, per_packet):
                    held.append(batch.slice(start, per_packet))
            while held and (batch is None or sum(b.num_rows for b in held) >= per_packet):
                whole = pa.Table.from_batches(held).combine_chunks()
                first = whole.slice(0, per_packet).combine_chunks().to_batches()[0]
                held = [b for b in whole.slice(per_packet).to_batches() if b.num_rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([taken(first.column(c), c)], pa.binary()) for c in schema.names], names=schema.names
                )

    return store(arrow_step(rows, packed, schema), label, **_SMALL_GROUPS)


def checked(classes: DataFrame, bounds: DataFrame, k: int, settings: Settings) -> DataFrame:
    """Rows (query, class, near) of all blocks that may hold something nearer than ``bounds``.

    ``bounds`` has (query, vector, least): the score that a class must reach. Queries are
    compared in tiles with packets of vectors in the order of one curve. Every tile meets every packet in a
    cartesian product, which reads the stored ones again: no copies of them are shuffled or broadcast.
    """
    width = classes.select(F.size("vector").alias("n")).first()
    if width is None:
        return classes.sparkSession.createDataFrame([], _FOUND)
    per_packet = max(settings.block, settings.packet_bytes // (8 * width.n))
    ordered = _keyed(classes.select("class", "vector"), [0], settings)
    packets = _packets(ordered.select("class", "vector"), per_packet, "ann-packets")
    n_tiles = -(-bounds.count() // settings.tile) or 1
    tiles = _packets(bounds.select("query", "least", "vector").repartition(n_tiles), settings.tile, "ann-tiles")
    tiles = tiles.withColumnRenamed("vector", "wanted")
    # Joins by a key might be planned as a broadcast of one side, by its size before it is multiplied.
    pairs = packets.hint("shuffle_replicate_nl").crossJoin(tiles).select("query", "least", "wanted", "class", "vector")
    block, count = settings.block, k + 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Least score of each query of a tile; it grows with what the task has found.
        reached: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                tile, first, wanted, number, unit = (batch.column(c)[i].as_py() for c in range(5))
                query, number = np.frombuffer(tile, np.int64), np.frombuffer(number, np.int64)
                least = reached.setdefault(tile, np.frombuffer(first, np.float64) - _SLACK)
                wanted = np.frombuffer(wanted, np.float64).reshape(len(query), -1)
                unit = np.frombuffer(unit, np.float64).reshape(len(number), -1)
                found = []
                for start in range(0, len(number), block):
                    own = unit[start : start + block]
                    centre = own.mean(0)
                    length = np.linalg.norm(centre)
                    if length > 0:
                        centre /= length
                        reach = np.arccos(np.clip((own @ centre).min(), -1, 1))
                        apart = np.arccos(np.clip(wanted @ centre, -1, 1))
                        may = np.flatnonzero(np.cos(np.maximum(0, apart - reach)) >= least)
                    else:
                        may = np.arange(len(query))
                    if not len(may):
                        continue
                    scores = wanted[may] @ own.T
                    row, column = np.nonzero(scores >= least[may][:, None])
                    found.append((may[row], start + column, scores[row, column]))
                if not any(len(f[0]) for f in found):
                    continue
                at, seen, near = (np.concatenate(c) for c in zip(*found, strict=True))
                # The best of the packet are enough: the count-th of a query and all that tie with it.
                order = np.lexsort((-near, at))
                at, seen, near = at[order], seen[order], near[order]
                begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                sizes = np.diff(np.r_[begins, len(at)])
                last = near[begins + np.minimum(sizes, count) - 1] - _SLACK
                kept = near >= np.repeat(last, sizes)
                full = sizes >= count
                least[at[begins[full]]] = np.maximum(least[at[begins[full]]], last[full])
                yield _found([query[at[kept]]], [number[seen[kept]]], [near[kept]])

    return arrow_step(pairs, compare, _FOUND)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; components of any size."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    length = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))

    def plain(x: Column, y: Column) -> Column:
        return total(F.zip_with(x, y, lambda v, w: v * w)) / (length(x) * length(y))

    def scaled(x: Column) -> Column:
        most = F.array_max(F.transform(x, lambda v: F.abs(v)))
        return F.transform(x, lambda v: v / most)

    # Squares of very large or small components leave the range of doubles.
    inside = length(a).between(1e-100, 1e100) & length(b).between(1e-100, 1e100)
    return F.when(inside, plain(a, b)).otherwise(plain(scaled(a), scaled(b)))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest rows of each query row.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor
    rows without an id. Vectors of another length than most (ties: the shorter) take no
    part. A query's own row is no candidate; another row with the same id or vector is.
    Ties go to the smaller vec_id. With fewer candidates all are returned; an empty table
    gives an empty result. ``settings.exact`` off leaves out the check after the windows.
    """
    id_type = vectors.schema[vec_id].dataType
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (width.n if width else 0))
    classes = vector_classes(rows, k)
    found = windows(classes, k, settings).distinct()
    top = Window.partitionBy("query").orderBy(F.desc("near"), "class")
    ranked = store(found.groupBy("query", "class").agg(F.max("near").alias("near")), "ann-windows")
    if settings.exact:
        # The score of the k+1-th class found, or none where the windows gave fewer.
        least = (
            ranked.withColumn("nth", F.row_number().over(top)).where(F.col("nth") == k + 1).select("query", F.col("near").alias("least"))
        )
        asked = classes.where("asked").select(F.col("class").alias("query"), "vector")
        bounds = asked.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        more = checked(classes, store(bounds, "ann-bounds"), k, settings)
        ranked = ranked.unionByName(more).groupBy("query", "class").agg(F.max("near").alias("near"))
        ranked = store(ranked, "ann-ranked")
    # All that tie with the k+1-th up to rounding are rescored, however many they are.
    first = ranked.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1)
    reached = first.groupBy("query").agg(F.min("near").alias("least"))
    few = ranked.join(reached, "query").where(F.col("near") >= F.col("least") - _SLACK).select("query", "class")
    candidate = classes.select("class", F.col("vector").alias("there"), "ids")
    asked = classes.where("asked").select(F.col("class").alias("query"), F.col("vector").alias("here"))
    scored = few.join(candidate, "class").join(asked, "query").select(
        "query", "ids", (F.col("query") == F.col("class")).alias("own"), cosine(F.col("here"), F.col("there")).alias("score"),
        F.col("here").alias("vector"),
    )
    # At most k + 1 entries for each distinct query vector; each task cuts its own first.
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "id", "own")
    entries = scored.select("query", "vector", "own", F.explode("ids").alias("id"), "score")
    entries = entries.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1)
    lists = entries.groupBy("vector").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "own"))).alias("entries")
    )
    own_place = F.array_position(F.transform("entries", lambda e: e["own"] & (e["id"] == F.col("vec_id"))), True)
    others = F.filter(F.col("entries"), lambda e, i: i + 1 != F.col("place"))
    placed = rows.where("query").join(lists, "vector").withColumn("place", own_place)
    listed = placed.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "e"))
    return listed.select(
        F.col("query_id").cast(id_type),
        (F.col("rank") + 1).cast("int").alias("rank"),
        F.col("e.id").cast(id_type).alias("vec_id"),
        (-F.col("e.far")).alias("score"),
    )
