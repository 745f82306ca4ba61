"""Shards by a tree of weighted hash draws: region, rack, shard.

A row goes down the tree. At each level every child draws an exponential number from a hash
of the row's key and the child's name, divided by the child's weight (the sum of the
weights of the shards below it); the smallest draw wins. A child's draw depends on nothing
but its own name and weight, so a change of weights moves rows only into or out of the
subtrees whose weights have changed. :func:`layout` gives every shard beyond the first
ones a region of its own: one more shard takes rows into itself and moves no others.

Only DataFrame functions are used. Rows with equal keys share a shard. Null keys count as
an empty text; empty tables give empty results. The operator's columns take the place of
columns of the same name (upper and lower case count as equal), all others stay. Slots
number the rows of a shard from 0 without gaps, along the order that the caller names; rows
equal in it are numbered in any order. The numbering cuts each shard into even segments, so
neither a large shard nor a key with very many rows meets in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telelake.llm.rows import fresh
from telelake.plans.running import POSITION, SEGMENT, in_segments

# Hexadecimal digits of a digest that make a draw: 52 bits, exact as a double.
DIGITS = 13
_SCALE = float(1 << 4 * DIGITS)


class Leaf(NamedTuple):
    """A shard and its place in the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, first: int = 24, per_rack: int = 4, racks: int = 3) -> list[Leaf]:
    """Shards 0 to ``shards`` - 1: the ``first`` ones in full regions, each later one in its own."""
    return [
        Leaf(f"r{n // (per_rack * racks)}", f"k{n // per_rack}", n) if n < first else Leaf(f"s{n}", f"s{n}", n)
        for n in range(shards)
    ]


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential number of the rate ``weight``, fixed by key and name."""
    digest = F.md5(F.concat(F.lit(f"{name}/"), key))
    number = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return -F.ln((number + 0.5) / F.lit(_SCALE)) / F.lit(float(weight))


def _choice(key: Column, children: dict[str, float], then: dict[str, Column]) -> Column:
    """What ``then`` holds for the child with the smallest draw; equal draws go by name."""
    if len(children) == 1:
        return then[next(iter(children))]
    best = F.least(*[F.struct(draw(key, n, w).alias("draw"), F.lit(n).alias("name")) for n, w in children.items()])
    # One element: the draws are made once, whatever hangs below.
    return F.element_at(F.transform(F.array(best.getField("name")), lambda won: _pick(won, then)), 1)


def _pick(won: Column, then: dict[str, Column]) -> Column:
    [(first, result), *others] = then.items()
    picked = F.when(won == first, result)
    for name, result in others:
        picked = picked.when(won == name, result)
    return picked


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """Shard of a key: draws among regions, then among the racks and the shards of the winner."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    return _descend(leaves, lambda children, then: _choice(key, children, then), F.lit)


def _descend(leaves: Sequence[Leaf], choose: Callable, shard: Callable):
    """The choices of the three levels, put together from the shards up."""
    tree: dict = defaultdict(lambda: defaultdict(dict))
    for leaf in leaves:
        if leaf.weight > 0:
            tree[leaf.region][f"{leaf.region}/{leaf.rack}"][f"{leaf.region}/{leaf.rack}/{leaf.shard}"] = leaf
    if not tree:
        raise ValueError("no shard has a weight above zero")
    regions, inside = {}, {}
    for region, racks in tree.items():
        weights = {rack: sum(s.weight for s in shards.values()) for rack, shards in racks.items()}
        below = {
            rack: choose({n: s.weight for n, s in shards.items()}, {n: shard(s.shard) for n, s in shards.items()})
            for rack, shards in racks.items()
        }
        regions[region] = sum(weights.values())
        inside[region] = choose(weights, below)
    return choose(regions, inside)


def place(df: DataFrame, key: str, leaves: Sequence[Leaf], order: Sequence[str], segments: int | None = None) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; rows of a shard are numbered along ``order``."""
    base = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot") and c != key])
    # Rows that are equal in the order can be dealt to several segments all the same.
    tie = fresh("tie")
    rows = base.withColumn("shard", shard_of(F.col(f"`{key}`"), leaves)).withColumn(tie, F.monotonically_increasing_id())
    stored = in_segments(rows, ["shard"], [*[F.col(f"`{c}`") for c in order], F.col(tie)], segments)
    counts = stored.groupBy("shard", SEGMENT).agg(F.count(F.lit(1)).alias("_n"), F.min(POSITION).alias("_first"))
    # At most one row per segment and one per shard.
    before = Window.partitionBy("shard").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", SEGMENT, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    placed = stored.join(F.broadcast(starts), ["shard", SEGMENT])
    kept = [f"`{c}`" for c in base.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*kept, "shard", (F.col(POSITION) + F.col("_start")).alias("slot"))


def write(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One directory per shard, its rows in slot order; a large shard has several files."""
    part = F.floor(F.col("slot") / rows_per_file)
    dealt = placed.repartition(F.col("shard"), part).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


SHARDS = 24


def documents(docs: DataFrame) -> DataFrame:
    """Size, checksum, shard, slot and shard after growth by one for ``doc_id`` and ``text``."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(narrow, "doc_id", layout(SHARDS), ["doc_id", "size", "text_crc32"])
    return placed.withColumn("grown_shard", shard_of(F.col("doc_id"), layout(SHARDS + 1)))


def _sql_choice(children: dict[str, float], then: dict[str, str]) -> str:
    if len(children) == 1:
        return then[next(iter(children))]

    def draw_of(name: str) -> str:
        return f"-ln((CAST(('0x' || substr(md5('{name}/' || key), 1, {DIGITS})) AS BIGINT) + 0.5) / {_SCALE!r}) / {float(children[name])!r}"
    structs = ", ".join("{'d': %s, 'n': '%s'}" % (draw_of(n), n) for n in children)
    cases = " ".join(f"WHEN '{n}' THEN {r}" for n, r in then.items())
    return f"(CASE list_min([{structs}]).n {cases} END)"


def sql_shard(leaves: Sequence[Leaf]) -> str:
    """:func:`shard_of` for a text column ``key``."""
    return _descend(leaves, _sql_choice, str)


def sql() -> str:
    """The registered query; the checksum's table of 256 entries is made from its polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE b(i, k, c) AS (
        SELECT range, 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, k + 1, {step} FROM b WHERE k < 8),
      t AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
      d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, encode(coalesce(text, '')) AS bytes FROM documents),
      s AS (SELECT doc_id, key, CAST(octet_length(bytes) + 8 AS BIGINT) AS size,
        CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
        FROM d, t),
      p AS (SELECT *, CAST({sql_shard(layout(SHARDS))} AS INTEGER) AS shard,
        CAST({sql_shard(layout(SHARDS + 1))} AS INTEGER) AS grown_shard FROM s)
      SELECT doc_id, size, text_crc32, 'key' AS law, shard,
        row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM p"""
