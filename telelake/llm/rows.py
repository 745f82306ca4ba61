"""Helpers of this subpackage: row-preserving Arrow steps and shared intermediate tables.

Every row-preserving operator adds exactly one struct column and leaves all other columns
as they are, whatever their names. If the input already has a column of that name (upper
and lower case count as equal), the operator's column takes its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructField, StructType

from telelake.session import scratch_path, ship

# Texts are worked through in groups of about so many characters, which bounds the memory
# of a task however long its Arrow batches are. A longer text is a group of its own.
GROUP_CHARS = 4_000_000

# Rows in a batch that a row step returns.
ROWS = 2048


def add_struct(
    df: DataFrame,
    out: str,
    fields: StructType,
    columns: list[str],
    make: Callable[[], Callable[..., pa.StructArray]],
) -> DataFrame:
    """``df`` with a struct column ``out``.

    ``make`` runs once per task and returns a function from the Arrow arrays of
    ``columns`` to the new array; it gets groups of rows bounded by ``GROUP_CHARS``.
    The first of ``columns`` is the text that the groups are measured by.
    """
    base = df.drop(*[c for c in df.columns if c.lower() == out.lower() and c not in columns])
    kept = [c for c in base.columns if c.lower() != out.lower()]
    names = [*kept, out]
    inputs = [f"_in{i}" for i in range(len(columns))]
    wide = base.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)],
        *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, inputs, strict=True)],
    )
    # Input columns that are also passed through travel once.
    shared = {n: f"_c{kept.index(c)}" for c, n in zip(columns, inputs, strict=True) if c in kept}
    wide = wide.drop(*shared)
    schema = StructType(
        [StructField(f"_c{i}", base.schema[c].dataType) for i, c in enumerate(kept)]
        + [StructField("_out", fields)]
    )
    passed = [f"_c{i}" for i in range(len(kept))]
    sources = [shared.get(n, n) for n in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in groups(batch, sources[0]):
                made = work(*[part.column(s) for s in sources])
                yield pa.RecordBatch.from_arrays(
                    [part.column(p) for p in passed] + [made], names=[*passed, "_out"]
                )

    return arrow_step(wide, run, schema).toDF(*names)


def arrow_step(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``run`` on the Arrow batches of each task; its workers get the package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def row_step(df: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each task, streamed in their order."""
    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for row in work(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            waiting.append(row)
            if len(waiting) == ROWS:
                yield made(waiting)
                waiting = []
        if waiting:
            yield made(waiting)

    return arrow_step(df, run, kind)


def groups(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``GROUP_CHARS`` bytes of text each."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes, dtype=np.int64) // GROUP_CHARS
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(start), int(end - start))


def struct_array(fields: StructType, *arrays) -> pa.StructArray:
    """Arrow struct of the Spark type ``fields`` from lists, numpy or Arrow arrays."""
    types = [to_arrow_type(f.dataType) for f in fields]
    made = [a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, t in zip(arrays, types, strict=True)]
    return pa.StructArray.from_arrays(
        [a.cast(t) if a.type != t else a for a, t in zip(made, types, strict=True)],
        fields=[pa.field(f.name, t) for f, t in zip(fields, types, strict=True)],
    )


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def store(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` to the folder that all executors share and go on from the written table; ``options`` of the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(prefix: str) -> str:
    """A column name that no input has."""
    return f"_{prefix}_{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
