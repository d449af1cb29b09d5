"""Conversation repair against exhaustive search over edits, whole and in pieces."""

import hashlib
import heapq
import random
import zlib

import pytest

from tidemark.llm import turns

SPACE = " \t\n\x0b\x0c\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def solve(rows):
    """Uniform-cost search on (cost, audit), which meets the ASCII-least of the cheapest audits first."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, best = [(0, "", 0, 0, ())], {}
    while heap:
        cost, audit, i, q, made = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return faults, cost, audit, "\n".join(made)
        if best.setdefault((i, q), (cost, audit)) < (cost, audit):
            continue
        todo = [("I", 5, i, x, (f"{ROLE[x]}:",)) for x in NEXT[q] if x != "s"]
        if i < len(rows):
            role, text = rows[i]
            todo.append(("D", 2, i + 1, None, ()))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                todo += [("R", 1 + more, i + 1, x, (f"{ROLE[x]}:{text}",)) for x in NEXT[q] if x != "s"]
                if role[:1] in NEXT[q]:
                    todo.append(("K", more, i + 1, role[:1], (f"{role}:{text}",)))
        for letter, price, to, x, line in todo:
            heapq.heappush(heap, (cost + price, audit + letter, to, q if x is None else NEXT[q][x], made + line))


def model(rows, hurt=True):
    out = {r[0]: [] for r in rows}
    for r in damaged(rows) if hurt else rows:
        out[r[0]].append(r[1:])
    want = {}
    for conv, mine in out.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, cost, audit, text = solve([r[1:] for r in mine])
        told = [r[0] for r in mine if r[0] is not None]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        want[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return want


def talks(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "cut off", " \n", "", None, "ä日.", f"t{rng.random()}?", f"t{rng.random()}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += rows[:: max(1, len(rows) // 20)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)


def digests(df):
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_audits(spark):
    rows = talks(1, 150, 9)
    assert digests(turns.audits(turns.damage(frame(spark, rows)), "copies")) == model(rows)
    assert digests(turns.audits(frame(spark, rows))) == model([(c, t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], hurt=False)
    assert turns.audits(frame(spark, rows).filter("false")).count() == 0


def test_dropped_conversations_stay(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = digests(turns.audits(turns.damage(frame(spark, [(gone, 0, "user", "Hi.")])), "copies"))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversations_in_pieces(spark, monkeypatch):
    """One conversation holds most rows, over many ranges and pieces."""
    rows = talks(2, 12, 8) + [(99, *r[1:]) for r in talks(3, 8, 60)]
    rows += [(99, 5, "user", "Same.")] * 40
    small = turns._pieces
    monkeypatch.setattr(turns, "_pieces", lambda it, lines: _limited(small, it, lines))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert digests(turns.audits(turns.damage(frame(spark, rows)), "copies")) == model(rows)
        lines = turns.repair(turns.damage(frame(spark, rows)), "copies").orderBy("conv_id", "piece", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    text = {}
    for r in lines:
        text.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = {c: v[7] for c, v in model(rows).items()}
    assert {c: hashlib.sha256("\n".join(text.get(c, [])).encode()).hexdigest() for c in want} == want


def _limited(fn, it, lines):
    turns.PIECE_ROWS = 9
    return fn(it, lines)


@pytest.mark.parametrize("seed", range(40))
def test_pieces_meet(seed):
    """The walk through pieces equals the walk through the whole, wherever it is cut."""
    rng = random.Random(seed)
    codes = [(rng.choice(["s", "u", "a", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(40))]
    dist = turns.distances(codes, turns._END)
    whole = turns.walk(codes, dist, 0)
    cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(3))
    parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
    ends, v = [], turns._END
    for part in reversed(parts):
        ends.append(v)
        m = [turns.distances(part, [0 if p == q else turns._FAR for p in range(4)])[:4] for q in range(4)]
        v = [min(m[q][p] + v[q] for q in range(4)) for p in range(4)]
    audit, q = "", 0
    for part, end in zip(parts, ends[::-1]):
        got, q = turns.walk(part, turns.distances(part, end), q)
        audit += got
    assert (audit, q) == whole and v[0] == dist[0]
