"""Structure repair and prefix trie of conversations against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telelake.llm import conversation_repair as R
from telelake.llm import prefix_trie as P

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, `_tie` string, `Position` string, `key` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd(spark):
    """Nulls in each column, ties, repeated rows, foreign roles, clashing names, one very long conversation."""
    rows = [
        (1, 0, "system", "Be kind.", "x", "y", "z"),
        (1, 1, "user", "Hi.", "x", "y", "z"),
        (1, 1, "user", "Hi.", "x", "y", "z"),
        (1, None, "assistant", "No turn", "x", "y", "z"),
        (1, 2, None, "No role!", None, None, None),
        (1, 3, "assistant", None, None, None, None),
        (2, None, None, None, None, None, None),
        (None, None, None, None, None, None, None),
        (None, 4, "user", "Nobody's.", None, None, None),
        (3, 7, "", "Empty role.", None, None, None),
        (4, 0, "tool", "{}", None, None, None),
        (4, 0, "sage", "Other s.", None, None, None),
        (5, -(1 << 63), "user", "far", None, None, None),
        (5, (1 << 63) - 1, "assistant", "x" * 200_000, None, None, None),
        (-7, 0, "user", "below zero?", None, None, None),
    ]
    rows += [(20 + n, t, "user" if t % 2 == 0 else "assistant", f"Same {t}.", None, None, None) for n in range(40) for t in range(n % 6)]
    pick = random.Random(3)
    for t in range(900):
        text = pick.choice(["Yes.", "No!", " \t\n", "cut off", f"Number {t}.", "ünd 漢字?"])
        rows.append((60, t, pick.choice(["user", "assistant", "system", "tool"]), text, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def cheapest(signs) -> tuple[int, str]:
    """Least cost and least letters, by trying every edit at every place from the end."""

    def add(cost, letter, rest):
        return cost + rest[0], letter + rest[1]

    after: list = [None] * 4
    for place in range(len(signs), -1, -1):
        here: list = [(10**9, "")] * 4
        for q in range(4):
            found = []
            if place == len(signs):
                found += [(0, "")] if q in (R.START, R.ASSISTANT) else []
            else:
                sign = signs[place]
                late = int(sign > 4)
                found.append(add(3, "D", after[q]))
                if sign:
                    kept = R.KEEP.get(R.INITIALS[(sign - 1) % 4], {})
                    found += [add(late, "K", after[kept[q]])] if q in kept else []
                    found.append(add(2 + late, "R", after[R.NEXT[q]]))
            here[q] = min(found, default=(10**9, ""))
        for _ in range(4):
            here = [min(here[q], add(2, "I", here[R.NEXT[q]])) for q in range(4)]
        after = here
    return after[R.START]


def audit(rows) -> set:
    by: dict = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append([" " if v is None else v for v in (r.conv_id, r.turn, r.role, r.text)] + [r.turn])
    out = set()
    for conv, given in by.items():
        made = []
        for name, number, role, text, turn in given:
            kind = zlib.crc32(f"{name}:{number}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                made += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        made.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        counts, seen, signs = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in made:
            bare = "".join(WORD.findall(text))
            wrong = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if wrong:
                counts[wrong] += 1
            signs.append(R.symbol(role, wrong in ("blank", "duplicate"), wrong == "truncated"))
        turns = [t for t, _, _ in made if t is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), (1 << 63) - 1) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(made, made[1:], strict=False))
        cost, letters = cheapest(signs)
        left, rest, q = [], iter(made), R.START
        for letter in letters:
            role, text = (R.ROLES[q], "") if letter == "I" else next(rest)[1:]
            if letter == "D":
                continue
            left.append((R.ROLES[q] if letter == "R" else role) + ":" + text)
            q = R.KEEP[role[:1]][q] if letter == "K" else R.NEXT[q]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in left))
        out.add((conv, gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def test_tables_give_the_cheapest_edits():
    pick, known = random.Random(1), R.tables()
    for _ in range(1500):
        signs = bytes(pick.randrange(9) for _ in range(pick.randrange(1, 30)))
        edits, _ = known.trace(signs, R.END, R.START, True)
        _, vector, low = known.cuts(signs, known.number[R.normalised(R.END)[1]])
        assert (low + known.vectors[vector][R.START], "".join(edits)) == cheapest(signs)


def test_parts_joined_by_matrices_equal_the_whole():
    pick, known = random.Random(5), R.tables()
    for _ in range(300):
        parts = [bytes(pick.randrange(9) for _ in range(pick.randrange(1, 8))) for _ in range(pick.randrange(1, 5))]
        costs, after = R.END, []
        for part in reversed(parts):
            after.insert(0, costs)
            matrix = known.matrix(part)
            costs = [min(matrix[4 * q + p] + costs[p] for p in range(4)) for q in range(4)]
        made, q = "", R.START
        for n, part in enumerate(parts):
            edits, q = known.trace(part, after[n], q, n == len(parts) - 1)
            made += "".join(edits)
        assert (costs[R.START], made) == cheapest(b"".join(parts))


@pytest.mark.parametrize("source", ["odd", "table"])
def test_audit(spark, source):
    rows = odd(spark) if source == "odd" else spark.read.parquet(f"{SF}/conversations.parquet")
    assert {tuple(r) for r in R.audited(rows).collect()} == audit(rows.collect())


def test_segments_do_not_show(spark):
    rows = R.damage(odd(spark))
    one = R.repair(rows, segments=1).collect()
    many = R.repair(rows, segments=23).collect()
    def plain(log):
        log = sorted(log, key=lambda r: (r.position, r.nth))
        return [(r.conv_id, r.edit, r.fault, r.turn, r.given_role, r.role, r.text) for r in log]
    assert plain(one) == plain(many)
    assert {r.edit for r in one} == set("KRDI")


def test_repair_of_nothing(spark):
    assert R.audited(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(n for n in range(200) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    [row] = R.audited(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def trie(rows) -> set:
    by: dict = {}
    for r in rows:
        if r.conv_id is not None:
            by.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    by = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    nodes: dict = {}
    whole = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = by.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(tuple(whole[c][:d]), []).append(c)
    children: dict = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums, out = {}, set()
    for p in sorted(nodes, key=len, reverse=True):
        below = [sums[x] for x in children.get(p, [])]
        own = (len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        sums[p] = sum(x[0] for x in below) if below else 1, own + sum(x[1] for x in below)
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(whole[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), parent, len(members), len(children.get(p, [])), *sums[p], digest))
    return out


def test_parentheses():
    pick = random.Random(2)
    for _ in range(60):
        depths = [0]
        for _ in range(pick.choice([0, 1, 4, 60, 2500])):
            depths.append(pick.randint(1, depths[-1] + 1) if pick.random() < 0.5 else depths[-1] + 1)
        tree = P.Parentheses(np.array(depths))
        values = np.array([pick.randrange(-50, 50) for _ in depths])
        for at in pick.sample(range(len(depths)), min(len(depths), 40)):
            end = next((n for n in range(at + 1, len(depths)) if depths[n] <= depths[at]), len(depths))
            assert tree.last[at] == end - 1
            assert tree.total(values)[at] == values[at:end].sum() and tree.least(values)[at] == values[at:end].min()


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


@pytest.mark.parametrize("source", ["odd", "table"])
def test_trie(spark, source):
    rows = odd(spark) if source == "odd" else spark.read.parquet(f"{SF}/conversations.parquet")
    found = [tuple(r) for r in P.nodes_with_ends(rows).select(COLUMNS).collect()]
    assert len(found) == len(set(found)) and set(found) == trie(rows.collect())


def test_shards_do_not_show(spark):
    found = P.rebuilt(odd(spark)).cache()
    def plain(shards):
        return [sorted(map(tuple, df.select(sorted(df.columns)).fillna(-99).collect())) for df in P.build(found, shards)]
    assert plain(1) == plain(2) == plain(40)


def test_trie_of_nothing(spark):
    assert P.nodes_with_ends(spark.createDataFrame([], SCHEMA)).collect() == []
    assert P.nodes_with_ends(odd(spark).where(F.col("conv_id").isNull())).collect() == []
