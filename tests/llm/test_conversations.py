"""Conversation repair against a plain version that tries edits row by row over whole conversations."""

import hashlib
import heapq
import random
import zlib

import pytest

from tests_shared import FOLDER  # noqa: I001
from tracestrata.llm import conversation_repair as repair

BLANK = " \t\n\v\f\r"
MOVES = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain(given):
    """The query's rows from (conv_id, turn, role, text), one conversation at a time."""
    chats = {c: [] for c, *_ in given}
    for c, turn, role, text in given:
        name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        chats[c] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, rows in chats.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            shown = text.rstrip(BLANK)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen
                          else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        starts = [role[:1] for _, role, _ in rows]
        cost, audit, lines = cheapest(rows, faults)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def cheapest(rows, faults):
    """Least (cost, audit) by best-first search over (rows read, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        forced = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[forced]
        heapq.heappush(heap, (cost + 2, audit + "I", i, forced, (*lines, f"{name}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
        if faults[i] not in ("blank", "duplicate"):
            extra = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, forced, (*lines, f"{name}:{text}")))
            if role[:1] and role[:1] in MOVES[last]:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


SCHEMA = "conv_id long, turn long, role string, text string"


def got(spark, given):
    docs = spark.createDataFrame([(*r, "x", 7) for r in given], SCHEMA + ", audit string, part long")
    found = repair.report(repair.repair(repair.damaged(docs)))
    return sorted((tuple(r) for r in found.collect()), key=str)


def random_rows(seed, chats, most):
    rng = random.Random(seed)
    rows = []
    for c in range(chats):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"])
            text = rng.choice(["Yes.", "No!", "Well", " \n", "", None, "a. b", "é?", f"n{t}.", f"m{t}", f"k{t}!\n"])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


def test_against_plain(spark):
    given = random_rows(1, 150, 14) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes"), (None, None, None, None)]
    assert got(spark, given) == plain(given)


def test_table(spark):
    if FOLDER is None:
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    found = repair.report(repair.repair(repair.damaged(table)))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("rows", [3, 40])
def test_conversations_over_many_partitions(spark, monkeypatch, rows):
    monkeypatch.setattr(repair, "PART_ROWS", rows)
    monkeypatch.setattr(repair, "CHUNK", 50)
    given = random_rows(2, 12, 12) + [(c + 100, t, r, x) for c, t, r, x in random_rows(3, 2, 200)]
    given += [(500, 1, "user", "Same.")] * 60
    assert got(spark, given) == plain(given)


def test_nothing_is_left(spark):
    dropped = [(c, t) for c in range(60) for t in range(60) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:5]
    given = [(c, t, "user", "Yes.") for c, t in dropped]
    assert {r[0]: r[1:] for r in got(spark, given)} == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, _ in dropped}
    assert got(spark, []) == []


def test_long_text(spark):
    given = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "y. " * 500_000)]
    assert got(spark, given) == plain(given)


def test_block_walk_is_the_same_for_every_block_size(monkeypatch):
    rng = random.Random(4)
    symbols = [(rng.choice("suax"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(300)]
    whole = list(repair.walk(symbols, repair.START, repair.END))
    for size in (1, 7, 300):
        monkeypatch.setattr(repair.math, "isqrt", lambda n, size=size: size)
        assert list(repair.walk(symbols, repair.START, repair.END)) == whole
