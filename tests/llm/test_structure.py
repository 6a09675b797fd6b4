import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from centwise.llm import alignment as al
from centwise.llm import structure

BLANKS = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, audit, output) by a plain shortest-path search over (turn, last initial), least audit first.
    ``turns``: (initial, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if last == "end":
            return cost, audit, out
        if i == len(turns) and last in ("", "a"):
            heapq.heappush(heap, (cost, audit, i, "end", out))
        offer = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, offer, out + ((offer, None),)))
        if i < len(turns):
            x, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if not gone:
                c = cost + 3 * cut
                if x == offer or (x == "s" and last == ""):
                    heapq.heappush(heap, (c, audit + "K", i + 1, x, out + ((x, i),)))
                heapq.heappush(heap, (c + 3, audit + "R", i + 1, offer, out + ((offer, i),)))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows, hurt):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in hurt if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            bare = text.strip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, kept = cheapest(turns)
        names = {"u": "user", "a": "assistant"}
        lines, edits = [], iter(a for a in audit if a != "D")
        for (x, i), e in zip(kept, edits):
            lines.append(f"{mine[i][1] if e == 'K' else names[x]}:{'' if i is None else mine[i][2]}")
        numbers = [r[0] for r in mine if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], bad, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n=60, most=12):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool"]) if rnd.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rnd.choice(["Yes.", "No!", f"turn {t}.", f"cut {t}", " ", f"what {t}? \n", "ünïcode…."])))
    return rows


def got(df, every, run=structure.RUN):
    return sorted(map(tuple, structure.audited(df, every, run).collect()), key=str)


@pytest.mark.parametrize("run", [2, 32])
def test_contract_against_brute_force(spark, run):
    rows = conversations(1) + [(None, 3, "user", "null conversation."), (None, 4, None, None), (500, None, "assistant", "b."),
                               (500, None, "assistant", "a."), (500, 7, "user", "c."), (501, 10, "user", "far."), (501, 90, "assistant", "apart."),
                               (502, 1, "", "no role."), (503, 1, "sys", "only."), (504, 0, "user", None), (505, 2, "user", "w " * 20000 + ".")]
    rows += [next((c, t, "user", "gone.") for t in range(500) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0) for c in (600, 601)]
    rows += rows[:9]                                       # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("kind", "seq", "n", "audit", "copy", "at")})
    assert got(structure.damaged(df), df, run) == brute(rows, damage(rows))


def test_one_long_conversation(spark):
    """Cut in many runs and folded up several levels, whatever the partitioning."""
    rows = [(7, t, r, x) for _, t, r, x in ((0, i, *v[2:]) for i, v in enumerate(conversations(3, 90, 9)))]
    rows += [(8, 0, "user", "Short."), (8, 1, "assistant", "Reply.")]
    want = brute(rows, rows)
    assert len([r for r in rows if r[0] == 7]) > 300
    old, structure.FAN = structure.FAN, 3
    try:
        for parts, run in ((1, 2), (12, 3), (5, 32)):
            df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
            assert got(df, df, run) == want
    finally:
        structure.FAN = old


def test_repaired_turns_read_legally(spark):
    rows = conversations(5, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    for r in sorted(structure.repaired(df).collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    sums = {r.conv_id: r.repaired_sha256 for r in structure.audited(df).collect()}
    for conv, turns in lines.items():
        initials = "".join(r[0] for r, _ in turns)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2)
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == sums[conv]


def test_alignment_against_search():
    rnd = random.Random(2)
    for _ in range(400):
        letters = rnd.choice(["suaSUAoO-", "uaua-", "suao-", "UASa-", "uuuua-s"])
        symbols = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12)))
        cost, audit, _ = cheapest([(x.lower(), x == "-", x in "SUAO") for x in symbols])
        for size in (1, 3, 64):
            parts = [al.measure(symbols[i:i + size]) for i in range(0, len(symbols), size)]
            nodes = [m[:2] for m in parts]
            costs, ranks = al.fold(nodes)
            end = al.finish(costs, ranks)
            way = al.through(nodes, al.START, end)
            text = "".join(m[2][a * al.N + b] for m, a, b in zip(parts, way, way[1:])) + al.TAIL[end][1]
            assert (costs[end] + al.TAIL[end][0], text) == (cost, audit)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert structure.audited(structure.damaged(empty), empty).collect() == []
    assert structure.repaired(empty).collect() == []
