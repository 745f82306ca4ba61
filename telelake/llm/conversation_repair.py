"""Cheapest repair of conversation structure, decided by tables over blocks of rows.

A row becomes one of nine symbols: to be deleted, or one of four role initials, ending well
or cut off. Edits keep, re-role, delete or insert rows, until the role initials read
``(s?(ua)+)?``. Four states say where in that pattern a prefix ends; the cost still to come
from each state is a vector of four small numbers, of which only the differences matter.
Few such normalised vectors exist, so their change by every block of ``BLOCK`` symbols is
worked out once per task. A conversation is gone through from its end by one lookup per
block. Blocks are then expanded from the vector at their end, and the edits are read off
from the front, the smallest letter among the cheapest ones first, so that ties always go to
the least sequence of edit letters.

Scale: rows are cut into even segments along (conversation, turn). Conversations inside a
segment are repaired there, row by row as they stream by. The first and last one of a
segment may go on in its neighbours, so each of their parts is summed up as a matrix of
costs between states; the matrices of a conversation, one per segment, give the vector at
each cut and the state that the repair is in there. No step holds more than a segment, also
where one conversation has a third of all rows.

Conversations are told apart by ``conv_id``; null is a conversation of its own. Null roles
and texts count as one space. Rows are ordered by turn (nulls first), then role, then the first
``TIE_CHARS`` characters of the text, then its digest; equal rows come in any order. Empty
tables give empty logs. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telelake.llm.rows import row_step, store

# Symbols in a block; its tables have 9 ** BLOCK rows.
BLOCK = 3
SEGMENT_BYTES = 64 << 20
TIE_CHARS = 64
# monotonically_increasing_id keeps the partition number above these bits.
ROW_BITS = 33
SPACE = " \t\n\x0b\x0c\r"

# States of the pattern: nothing yet, s, user spoke last, assistant spoke last.
START, SYSTEM, USER, ASSISTANT = range(4)
# State after an inserted or re-roled row, and the role that it gets.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
# Symbol 0 has to be deleted, 1 to 4 are initials, 5 to 8 the same with a truncated text.
INITIALS = ("s", "u", "a", "")
SYMBOLS = range(9)
FAR = 1 << 60


def symbol(role: str, gone: bool, truncated: bool) -> int:
    if gone:
        return 0
    initial = role[:1] if role[:1] in KEEP else ""
    return 1 + INITIALS.index(initial) + 4 * truncated


def fault(text: str, seen: bool) -> str | None:
    """First fault of a row."""
    bare = text.strip(SPACE)
    if not bare:
        return "blank"
    if seen:
        return "duplicate"
    return None if bare[-1] in ".!?" else "truncated"


def _inserted(costs: list) -> tuple:
    """Costs from each state where rows may be inserted first."""
    one = [costs[NEXT[q]] for q in range(4)]
    two = [costs[NEXT[NEXT[q]]] for q in range(4)]
    return tuple(min(costs[q], 2 + one[q], 4 + two[q]) for q in range(4))


# Cost to come after the last row.
END = _inserted([0, FAR, FAR, 0])


def before(sign: int, after: tuple) -> tuple:
    """Cost to come before a row, from the cost to come after it."""
    costs = [3 + c for c in after]
    if sign:
        late = sign > 4
        kept = KEEP.get(INITIALS[(sign - 1) % 4], {})
        for q in range(4):
            costs[q] = min(costs[q], 2 + late + after[NEXT[q]], late + after[kept[q]] if q in kept else FAR)
    return _inserted(costs)


def edits_before(sign: int, after: tuple, q: int) -> tuple[str, int]:
    """Edits up to and including a row's own, from state ``q``: least letters among the cheapest."""
    here, made = before(sign, after), ""
    late = sign > 4
    kept = KEEP.get(INITIALS[(sign - 1) % 4], {}) if sign else {}
    while True:
        if here[q] == 3 + after[q]:
            return made + "D", q
        if here[q] == 2 + here[NEXT[q]]:
            made, q = made + "I", NEXT[q]
        elif q in kept and here[q] == late + after[kept[q]]:
            return made + "K", kept[q]
        else:
            return made + "R", NEXT[q]


# What is left to insert after the last row.
AT_END = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def normalised(costs) -> tuple[int, tuple]:
    """Least cost and what the others are above it."""
    low = min(costs)
    return low, tuple(c - low if c < FAR else FAR for c in costs)


def _only(state: int) -> tuple:
    """Costs where a sequence has to end in ``state``."""
    return tuple(0 if q == state else FAR for q in range(4))


class Tables:
    """Normalised vectors and what each block of symbols makes of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.expanded: dict[tuple, tuple] = {}
        # All vectors that any sequence leads to, from the end and from each single state.
        for costs in (END, *map(_only, range(4))):
            self._known(costs)
        self.step: list[list] = []
        while len(self.step) < len(self.vectors):
            vector = self.vectors[len(self.step)]
            self.step.append([self._known(before(s, vector)) for s in SYMBOLS])
        self.blocks: dict[tuple, list] = {}
        for size in range(1, block + 1):
            for signs in product(SYMBOLS, repeat=size):
                self.blocks[signs] = [self._through(signs, v) for v in range(len(self.vectors))]

    def _known(self, costs: tuple) -> tuple[int, int]:
        low, vector = normalised(costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], low

    def _through(self, signs: tuple, vector: int) -> tuple[int, int]:
        # The rest of the block is known already.
        low = 0
        if len(signs) > 1:
            vector, low = self.blocks[signs[1:]][vector]
        vector, more = self.step[vector][signs[0]]
        return vector, low + more

    def cuts(self, signs: bytes, vector: int) -> tuple[list, int, int]:
        """Blocks of a sequence with the vector after each, from the last one; vector and cost before all."""
        found, low, end = [], 0, len(signs)
        while end:
            begin = max(0, end - self.block)
            block = tuple(signs[begin:end])
            found.append((block, vector))
            vector, more = self.blocks[block][vector]
            low, end = low + more, begin
        return found, vector, low

    def expand(self, block: tuple, vector: int, q: int) -> tuple[list, int]:
        """Edits of the rows of a block that ends in ``vector`` and begins in state ``q``."""
        key = (block, vector, q)
        if key not in self.expanded:
            after = [self.vectors[vector]]
            for sign in reversed(block[1:]):
                after.append(before(sign, after[-1]))
            made = []
            for sign, costs in zip(block, reversed(after), strict=True):
                edits, q = edits_before(sign, costs, q)
                made.append(edits)
            self.expanded[key] = made, q
        return self.expanded[key]

    def trace(self, signs: bytes, after, q: int, last: bool) -> tuple[list, int]:
        """Edits of each row, from state ``q`` on, and the state after them; ``after``: the cost to come then."""
        found, _, _ = self.cuts(signs, self.number[normalised(after)[1]])
        made = []
        for block, vector in reversed(found):
            edits, q = self.expand(block, vector, q)
            made += edits
        if last:
            made[-1] += AT_END[q]
        return made, q

    def matrix(self, signs: bytes) -> list[int]:
        """Cheapest cost between the state before (row) and after (column) a sequence."""
        columns = []
        for p in range(4):
            _, vector, low = self.cuts(signs, self.number[_only(p)])
            columns.append([min(c + low, FAR) for c in self.vectors[vector]])
        return [columns[p][q] for q in range(4) for p in range(4)]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


RAW = "position bigint, conv_id {conv}, turn bigint, given_role string, text string, key binary, fault string"
LOG = "conv_id {conv}, position bigint, nth int, edit string, fault string, turn bigint, given_role string, role string, text string"
# Names and places of the columns of a log row.
CONV, POSITION, NTH, EDIT, FAULT, TURN, GIVEN, ROLE, TEXT = range(9)


def _after(edit: str, role: str, q: int) -> int:
    if edit == "D":
        return q
    return KEEP[role[:1]][q] if edit == "K" else NEXT[q]


def log_rows(raw: tuple, made: str, q: int) -> Iterator[tuple]:
    """A log row for each edit made at a row; ``q`` is the state before them."""
    position, conv, turn, given, text, _, wrong = raw
    for nth, edit in enumerate(made):
        if edit == "I":
            yield conv, position, nth, edit, None, None, None, ROLES[q], ""
        else:
            yield conv, position, nth, edit, wrong, turn, given, ROLES[q] if edit == "R" else given, text
        q = _after(edit, given, q)


def _repaired(run: list[tuple]) -> Iterator[tuple]:
    """Log of a whole conversation."""
    seen, rows, signs = set(), [], bytearray()
    for row in run:
        wrong = fault(row[4], row[5] in seen)
        seen.add(row[5])
        rows.append((*row[:6], wrong))
        signs.append(symbol(row[3], wrong in ("blank", "duplicate"), wrong == "truncated"))
    edits, _ = tables().trace(bytes(signs), END, START, True)
    q = START
    for row, made in zip(rows, edits, strict=True):
        yield from log_rows(row, made, q)
        for edit in made:
            q = _after(edit, row[3], q)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _inside(fold: Callable) -> Callable:
    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        """What ``fold`` makes of each conversation inside a segment; rows of the first and last as they are."""
        run: list[tuple] = []
        first = True
        for row in rows:
            if run and row[1] != run[-1][1]:
                if first:
                    yield from (((*r, fault(r[4], False)), None) for r in run)
                else:
                    yield from ((None, made) for made in fold(_repaired(run)))
                run, first = [], False
            run.append(row)
        yield from (((*r, fault(r[4], False)), None) for r in run)

    return work


def _parts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """First position, symbols and matrix of each part; a row is (segment, position, conversation, symbol)."""
    signs, first = bytearray(), None
    for row in rows:
        if first and (row[0], row[2]) != (first[0], first[2]):
            yield first[1], first[2], bytes(signs), tables().matrix(bytes(signs))
            signs, first = bytearray(), None
        first = first or row
        signs.append(row[3])
    if first:
        yield first[1], first[2], bytes(signs), tables().matrix(bytes(signs))


def _vectors(parts):
    """Cost to come after each part of a conversation; a part is a row of 16 numbers."""
    costs, found = END, []
    parts = parts.sort_values("first", ascending=False)
    for matrix in parts["matrix"]:
        found.append([int(c) for c in costs])
        costs = [min(matrix[4 * q + p] + costs[p] for p in range(4)) for q in range(4)]
    return parts[["first"]].assign(after=found, last=[n == 0 for n in range(len(parts))])


def _ends(rows: Iterator[tuple]) -> Iterator[tuple]:
    """State after a part for each state before it."""
    for first, conv, signs, after in rows:
        yield first, conv, [tables().trace(signs, after, q, False)[1] for q in range(4)]


def _states(parts):
    """State before each part of a conversation."""
    q, found = START, []
    parts = parts.sort_values("first")
    for ends in parts["ends"]:
        found.append(q)
        q = int(ends[q])
    return parts[["first"]].assign(state=found)


def _traced(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edits made at each row and the state before them."""
    for first, signs, after, last, q in rows:
        edits, _ = tables().trace(signs, after, q, last)
        for number, (sign, made) in enumerate(zip(signs, edits, strict=True)):
            yield first + number, made, q
            for edit in made:
                q = _after(edit, INITIALS[(sign - 1) % 4], q)


def _across(raw: DataFrame, conv: str) -> DataFrame:
    """Log of the conversations that may go on in another segment."""
    once = raw.groupBy("key").agg(F.min("position").alias("_once"))
    narrow = raw.select("position", "conv_id", "key", "given_role", "fault").join(once, "key")
    wrong = F.when(F.col("fault") == "blank", "blank").when(F.col("position") > F.col("_once"), "duplicate")
    narrow = narrow.withColumn("fault", F.coalesce(wrong, "fault"))
    initial = F.coalesce(*[F.when(F.startswith("given_role", F.lit(c)), n + 1) for n, c in enumerate("sua")], F.lit(4))
    sign = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(
        initial + F.when(F.col("fault") == "truncated", 4).otherwise(0)
    )
    segment = F.shiftright("position", ROW_BITS).alias("segment")
    narrow = store(narrow.select(segment, "position", "conv_id", sign.alias("sign"), "fault"), "repair-symbols")
    # At most two parts in a segment.
    ordered = narrow.drop("fault").repartition("segment").sortWithinPartitions("segment", "position")
    kind = f"first bigint, conv_id {conv}, "
    parts = store(row_step(ordered, _parts, kind + "signs binary, matrix array<bigint>"), "repair-parts")
    by_conv = parts.select("first", "conv_id", "matrix").groupBy("conv_id")
    vectors = by_conv.applyInPandas(_vectors, "first bigint, after array<bigint>, last boolean")
    known = store(parts.drop("matrix").join(vectors, "first"), "repair-vectors")
    ends = row_step(known.select("first", "conv_id", "signs", "after"), _ends, kind + "ends array<int>")
    states = ends.groupBy("conv_id").applyInPandas(_states, "first bigint, state int")
    full = known.join(states, "first").select("first", "signs", "after", "last", "state")
    traced = row_step(full, _traced, "position bigint, made string, state int")
    rows = raw.drop("fault").join(narrow.select("position", "fault"), "position").join(traced, "position")
    rows = rows.select(*[f.split()[0] for f in RAW.split(", ")], "made", "state")
    return row_step(rows, _logged, LOG.format(conv=conv))


def _logged(rows: Iterator[tuple]) -> Iterator[tuple]:
    for *raw, made, q in rows:
        yield from log_rows(tuple(raw), made, q)


def _by_conversation(fold: Callable) -> Callable:
    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, log in groupby(rows, key=lambda row: row[CONV]):
            yield from fold(log)

    return work


def repair(
    conversations: DataFrame,
    fold: Callable[[Iterator[tuple]], Iterator[tuple]] | None = None,
    schema: str = LOG,
    segments: int | None = None,
) -> DataFrame:
    """Log of edits of ``conversations`` (conv_id, turn, role, text).

    One row per edit, in order of (position, nth): K, R, D with the row's fault, turn, given
    and new role and text, I with the inserted role. The repaired conversation is the log without its
    deleted rows. With ``fold``, what it makes of each conversation's log, streamed to it in
    order, as rows of ``schema``; ``{conv}`` in it stands for the type of ``conv_id``.
    """
    conv = conversations.schema["conv_id"].dataType.simpleString()
    blank = F.lit(" ")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
    )
    name = F.concat(F.col("conv_id").isNull().cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    parts = [F.concat(F.length(c).cast("string"), F.lit("/"), c) for c in (name, F.col("role"), F.col("text"))]
    rows = rows.withColumn("key", F.unhex(F.sha2(F.concat(*parts), 256)))
    if segments is None:
        size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 64)).first()[0] or 0
        least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        segments = max(least, -(-size // SEGMENT_BYTES))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, TIE_CHARS), F.col("key")]
    order.append(F.col("_tie"))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(segments, *order)
    numbered = dealt.sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("position"), "conv_id", "turn", "role", "text", "key"
    )
    schema = schema.format(conv=conv)
    raw = StructType.fromDDL(RAW.format(conv=conv)).simpleString()
    made = StructType.fromDDL(schema).simpleString()
    inside = store(row_step(numbered, _inside(fold or iter), f"raw {raw}, made {made}"), "repair")
    across = _across(inside.where("raw is not null").select("raw.*"), conv)
    if fold:
        ordered = across.repartition("conv_id").sortWithinPartitions("conv_id", "position", "nth")
        across = row_step(ordered, _by_conversation(fold), schema)
    return inside.where("made is not null").select("made.*").union(across)


# Digest of the registered query.
SUMMARY = (
    "conv_id {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
    " audit string, repaired_sha256 string"
)
TOP = (1 << 63) - 1


def summary(log: Iterator[tuple]) -> Iterator[tuple]:
    """Faults, cheapest edits and digest of a conversation from its log; only the letters of the edits are kept."""
    faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    low = high = before = conv = None
    turns = illegal = cost = 0
    audit, digest, joint = [], hashlib.sha256(), ""
    for row in log:
        conv = row[CONV]
        audit.append(row[EDIT])
        cost += COSTS[row[EDIT]]
        if row[EDIT] != "D":
            cost += row[FAULT] == "truncated"
            digest.update(f"{joint}{row[ROLE]}:{row[TEXT]}".encode())
            joint = "\n"
        if row[EDIT] == "I":
            continue
        if row[FAULT]:
            faults[row[FAULT]] += 1
        if before is not None:
            illegal += before + row[GIVEN][:1] not in ("su", "ua", "au")
        before = row[GIVEN][:1]
        # Turns come in order.
        if row[TURN] is not None and row[TURN] != high:
            turns, low, high = turns + 1, row[TURN] if low is None else low, row[TURN]
    gaps = 0 if low is None else min(high - low + 1 - turns, TOP)
    yield conv, gaps, *faults.values(), illegal, cost, "".join(audit), digest.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by a checksum of conversation and turn."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])) % 20
    rows = conversations.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), kind.alias("_kind"))
    damaged = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    rows = rows.where("_kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        damaged.alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"),
    )
    return rows.drop("_copy")


def audited(conversations: DataFrame) -> DataFrame:
    """The registered query: each conversation of ``conversations`` after damage, its faults and repair."""
    found = repair(damage(conversations), summary, SUMMARY)
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    joined = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in "gaps blank duplicate truncated illegal cost".split()]
    return joined.select(
        F.col("_conv").alias("conv_id"),
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
