"""Repair of conversations: the cheapest edits that give roles in the order `(s?(ua)+)?`.

A conversation's rows and four states of its role order (nothing yet, after the system's turn, after a user's, after an
assistant's) span a layered graph.  An arc keeps a row (0), gives it the user's or assistant's role (1), deletes it (2) or
inserts an empty turn before it (5); keeping or renaming a truncated row costs 5 more, and blank rows and duplicates can only
be deleted.  Costs are small integers, so Dial's bucket queue settles the distances of all nodes to the end, and a walk
from the begin along tight arcs, taking the ASCII-least letter at each node, spells the least of all cheapest audits: the
letters of a node's arcs differ, so the greedy choice is right.

No conversation has to fit a task.  Rows are dealt to tasks in ranges of (conversation, turn, role, text), so a long
conversation is a row of *pieces*; what begins and ends within one range is solved there at once.  A piece is a 4 x 4 matrix
of distances, the matrices of a conversation tell what each piece's end still costs, and with that every piece walks from each
of its four entry states by itself.  Only the chain of states and the digest, a hash of one stream of lines, follow the
pieces in order, one at a time.  Duplicates are told by counted hashes before the rows are dealt out, and equal rows travel
as one row with a count.

Edge cases: null ids, turns, roles and texts count as one space (a null turn still sorts first and is left out of gaps); rows
without an id are one conversation; rows of one turn are ordered by role and text; copies of a row stand side by side and all
but the first are duplicates; a conversation whose rows were all dropped has zeros, an empty audit and the hash of an empty
string; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import lean, partitions, written

#: Rows and text bytes of a piece.
PIECE_ROWS = 20_000
PIECE_BYTES = 4 << 20

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: By initial, the states that a turn leads from and to.
_NEXT = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: From each state, the one state that an inserted or renamed turn leads to, and its role.
_TURN = {NONE: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: What a conversation's end costs in each state.
_END = [0, 2 * INSERT, INSERT, 0]
_FAR = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)
_LEGAL = {"su", "ua", "au"}

_ROWS = "array<struct<role:string,text:string,turn:long,fault:int>>"
_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIELDS = [x.split()[0] for x in _DIGEST.split(", ")]
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def moves(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state, the arcs (letter, cost, state behind the row) of a row, in the letters' order."""
    out = []
    more = TRUNCATED if fault == CUT_OFF else 0
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if fault in (SOUND, CUT_OFF):
            if q in _NEXT.get(initial, ()):
                arcs.append(("K", KEEP + more, _NEXT[initial][q]))
            arcs.append(("R", RENAME + more, _TURN[q][0]))
        out.append(arcs)
    return out


_MOVES = {(i, f): moves(i, f) for i in ("s", "u", "a", "") for f in range(4)}
_BACK = {k: [[(p, cost) for p in range(4) for _, cost, to in arcs[p] if to == q] for q in range(4)] for k, arcs in _MOVES.items()}
_BEFORE = [[p for p in range(4) if _TURN[p][0] == q] for q in range(4)]


def code(role: str, fault: int) -> tuple[str, int]:
    return (role[:1] if role[:1] in _NEXT else ""), fault


def distances(codes: list[tuple[str, int]], end: list[int]) -> list[int]:
    """The least cost from node 4 * row + state to behind the last row, where each state costs `end` more."""
    n = len(codes)
    dist, buckets = [_FAR] * (4 * n + 4), []

    def reach(node: int, d: int) -> None:
        if d < dist[node]:
            dist[node] = d
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append(node)

    for q, d in enumerate(end):
        if d < _FAR:
            reach(4 * n + q, d)
    at = 0
    while at < len(buckets):
        for node in buckets[at]:  # grows by arcs of cost 0
            if dist[node] == at:
                row, q = divmod(node, 4)
                if row < n:
                    for p in _BEFORE[q]:
                        reach(4 * row + p, at + INSERT)
                if row:
                    for p, cost in _BACK[codes[row - 1]][q]:
                        reach(4 * row - 4 + p, at + cost)
        buckets[at] = None
        at += 1
    return dist


def walk(codes: list[tuple[str, int]], dist: list[int], state: int) -> tuple[str, int]:
    """(the least audit among the cheapest, the state behind the last row), entering in a state."""
    out, row = [], 0
    while row < len(codes):
        here = dist[4 * row + state]
        arcs = [(letter, cost, row + 1, to) for letter, cost, to in _MOVES[codes[row]][state]]
        arcs.insert(1, ("I", INSERT, row, _TURN[state][0]))
        letter, _, row, state = next(x for x in arcs if dist[4 * x[2] + x[3]] + x[1] == here)
        out.append(letter)
    return "".join(out), state


def cost_of(codes: list[tuple[str, int]], audit: str) -> int:
    total, row = 0, 0
    for letter in audit:
        total += {"K": KEEP, "R": RENAME, "D": DELETE, "I": INSERT}[letter]
        if letter != "I":
            total += TRUNCATED if letter != "D" and codes[row][1] == CUT_OFF else 0
            row += 1
    return total


def edited(rows: list[tuple], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) that an audit makes of rows, entering in a state."""
    left = iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "K":
            yield row[0], row[1]
            state = _NEXT[row[0][0]][state]
        elif letter != "D":
            state, role = _TURN[state]
            yield role, "" if row is None else row[1]


class Conversation:
    """The digest of one conversation, met piece by piece."""

    def __init__(self) -> None:
        self.state, self.cost, self.audit, self.sha, self.lines = NONE, 0, [], hashlib.sha256(), 0
        self.count, self.illegal, self.last = [0] * 4, 0, None
        self.turns, self.least, self.turn = 0, None, None

    def meet(self, rows: list[tuple], audit: str, exit_state: int) -> list[tuple[str, str]]:
        for role, _, turn, fault in rows:
            self.count[fault] += 1
            self.illegal += self.last is not None and self.last + role[:1] not in _LEGAL
            self.last = role[:1]
            if turn is not None and (self.turn is None or turn != self.turn):
                self.turns, self.turn = self.turns + 1, turn
                self.least = turn if self.least is None else self.least
        lines = list(edited(rows, audit, self.state))
        self.add(lines)
        self.cost += cost_of([code(r[0], r[3]) for r in rows], audit)
        self.audit.append(audit)
        self.state = exit_state
        return lines

    def add(self, lines: list[tuple[str, str]]) -> None:
        for role, text in lines:
            self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.lines += 1

    def end(self) -> tuple[list[tuple[str, str]], tuple]:
        """(lines inserted behind the last row, the digest)."""
        self.cost += _END[self.state]
        lines = []
        while self.state in (SYSTEM, USER):
            self.state, role = _TURN[self.state]
            lines.append((role, ""))
        self.add(lines)
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        return lines, (gaps, self.count[BLANK], self.count[DUPLICATE], self.count[CUT_OFF], self.illegal, self.cost, "".join([*self.audit, "I" * len(lines)]), self.sha.hexdigest())


def fault(text: str, again: bool) -> int:
    bare = text.rstrip(_SPACE)
    if not bare:
        return BLANK
    return DUPLICATE if again else SOUND if bare[-1] in ".!?" else CUT_OFF


@lean
def _pieces(batches: Iterable[pa.RecordBatch], lines: bool) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, key, turn, role, text, copies, first) in order, as solved conversations and pieces of others."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seq, key, conv, rows, size, cut, first = 0, None, None, [], 0, False, True
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        nonlocal out
        columns, out = list(zip(*out)), []
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        kept = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("turn", pa.int64()), ("fault", pa.int32())]))
        kinds = [pa.int64(), pa.string(), pa.int64(), *_KINDS, turn, kept]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", "key", "piece", *_FIELDS, "lines", "rows"])

    def close(whole: bool) -> None:
        nonlocal seq, rows, size
        if whole:
            whole_one = Conversation()
            codes = [code(r[0], r[3]) for r in rows]
            made = whole_one.meet(rows, *walk(codes, distances(codes, _END), NONE))
            tail, digest = whole_one.end()
            out.append((conv, key, part << 32 | seq, *digest, [dict(zip(("role", "text"), x)) for x in made + tail] if lines else None, None))
        else:
            out.append((conv, key, part << 32 | seq, *[None] * 8, None, [dict(zip(("role", "text", "turn", "fault"), r)) for r in rows]))
        seq, rows, size = seq + 1, [], 0

    for b in batches:
        for c, k, turn, role, text, copies, new in zip(*(x.to_pylist() for x in b.columns)):
            if k != key:
                if key is not None:
                    close(not (first or cut))
                    first = False
                key, conv, cut = k, c, False
            for j in range(copies):
                if len(rows) >= PIECE_ROWS or size >= PIECE_BYTES:
                    close(False)
                    cut = True
                    yield batch()
                rows.append((role, text, turn, fault(text, j > 0 or not new)))
                size += len(text)
            if len(out) >= 1000:
                yield batch()
    if key is not None:
        close(False)
    if out:
        yield batch()


def _rows(column: pa.ListScalar) -> list[tuple]:
    return [(r["role"], r["text"], r["turn"], r["fault"]) for r in column.as_py()]


def _codes(column: pa.ListScalar) -> list[tuple[str, int]]:
    return [code(r[0], r[3]) for r in _rows(column)]


@lean
def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, piece, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            codes, ends = _codes(rows), []
            for q in range(4):
                ends.append(distances(codes, [0 if p == q else _FAR for p in range(4)])[:4])
            yield pa.RecordBatch.from_pydict({"key": [key], "piece": pa.array([piece], pa.int64()), "m": pa.array([[ends[q][p] for p in range(4) for q in range(4)]], pa.list_(pa.int64()))})


def _ends(table: pa.Table) -> pa.Table:
    """For each piece of a conversation, what its end still costs in each state, but for a constant."""
    got = table.sort_by("piece").to_pydict()
    v, out = list(_END), []
    for m in reversed(got["m"]):
        out.append([d - min(v) if d < _FAR else _FAR for d in v])
        v = [min(min(m[4 * p + q] + v[q] for q in range(4)), _FAR) for p in range(4)]
    return pa.table({"key": got["key"], "piece": pa.array(got["piece"], pa.int64()), "end": pa.array(out[::-1], pa.list_(pa.int64()))})


@lean
def _walks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            codes = _codes(b.column("rows")[k])
            dist = distances(codes, b.column("end")[k].as_py())
            found = [walk(codes, dist, q) if dist[q] < _FAR else ("", q) for q in range(4)]
            yield pa.RecordBatch.from_arrays([*b.slice(k, 1).select(["conv_id", "key", "piece", "rows"]).columns, pa.array([[x[0] for x in found]]), pa.array([[x[1] for x in found]], pa.list_(pa.int32()))], names=["conv_id", "key", "piece", "rows", "audits", "exits"])


@lean
def _joined(batches: Iterable[pa.RecordBatch], lines: bool) -> Iterator[pa.RecordBatch]:
    """Walked pieces in order: with lines, each piece's lines; without, each conversation's digest."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    key, conv, piece, now = None, None, 0, None

    def end() -> pa.RecordBatch:
        tail, digest = now.end()
        if lines:
            return told([(conv, piece + 1, tail)])
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, *digest), (pa.int64(), *_KINDS))], names=["conv_id", *_FIELDS])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"role": a, "text": t} for a, t in r[2]] for r in rows], kind)], names=["conv_id", "piece", "lines"])

    for b in batches:
        for k in range(b.num_rows):
            mine = b.column("key")[k].as_py()
            if mine != key:
                if now is not None:
                    yield end()
                key, conv, now = mine, b.column("conv_id")[k].as_py(), Conversation()
            piece, state = b.column("piece")[k].as_py(), now.state
            made = now.meet(_rows(b.column("rows")[k]), b.column("audits")[k].as_py()[state], b.column("exits")[k].as_py()[state])
            if lines:
                yield told([(conv, piece, made)])
    if now is not None:
        yield end()


def _flagged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number and whether each begins a run of equal roles and texts of its conversation."""
    key, at = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    same = F.when(F.col("copies") > 0, F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).otherwise("")
    rows = rows.select("conv_id", key.alias("key"), "turn", at.alias("at"), same.alias("same"), "role", "text", "copies")
    rows = rows.groupBy("key", "at", "same").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").cast("int").alias("copies"))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.filter("copies > 0").groupBy("key", "same").agg(F.min(order).alias("o")).select("key", "same", F.coalesce(F.col("o.turn").cast("string"), F.lit(" ")).alias("at"), F.lit(True).alias("first"))
    return rows.join(first, ["key", "at", "same"], "left").select("conv_id", "key", "turn", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"))


def _solved(rows: DataFrame, lines: bool) -> tuple[DataFrame, DataFrame]:
    """(solved conversations, walked pieces of the others)."""
    n = partitions(rows.sparkSession)
    flagged = written(_flagged(rows), "turns")
    dealt = flagged.repartitionByRange(n, "key", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    schema = f"conv_id long, key string, piece long, {_DIGEST}, lines array<struct<role:string,text:string>>, rows {_ROWS}"
    found = written(dealt.mapInArrow(lambda it: _pieces(it, lines), schema), "pieces")
    open_ = found.filter(F.col("rows").isNotNull()).select("conv_id", "key", "piece", "rows")
    matrices = open_.select("key", "piece", "rows").mapInArrow(_matrices, "key string, piece long, m array<long>")
    ends = matrices.groupBy("key").applyInArrow(_ends, "key string, piece long, end array<long>")
    walked = open_.join(ends, ["key", "piece"]).mapInArrow(_walks, f"conv_id long, key string, piece long, rows {_ROWS}, audits array<string>, exits array<int>")
    return found.filter(F.col("rows").isNull()), walked.repartition(n, "key").sortWithinPartitions("key", "piece")


def _filled(conversations: DataFrame, copies: str | None) -> DataFrame:
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)

    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), (F.col(copies).cast("int") if copies else F.lit(1)).alias("copies"))


def audits(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    copies: a column that tells how often a row stands there; 0 leaves no more of the row than its conversation's id.
    """
    whole, rest = _solved(_filled(conversations, copies), False)
    return whole.select("conv_id", *_FIELDS).unionByName(rest.mapInArrow(lambda it: _joined(it, False), f"conv_id long, {_DIGEST}"))


def repair(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired rows (conv_id, piece, place, role, text): a conversation's order is that of piece and place."""
    whole, rest = _solved(_filled(conversations, copies), True)
    pieces = whole.select("conv_id", "piece", "lines").unionByName(rest.mapInArrow(lambda it: _joined(it, True), "conv_id long, piece long, lines array<struct<role:string,text:string>>"))
    return pieces.select("conv_id", "piece", F.posexplode("lines").alias("place", "line")).select("conv_id", "piece", "place", "line.role", "line.text")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with the faults that crc32 of `conv_id:turn` modulo 20 deals out: 0 drops a
    row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = _filled(conversations, None).withColumn("fate", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
