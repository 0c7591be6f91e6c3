"""Conversation structure repair (operator 11): persistent audit dynamic programming.

A conversation's rows are read by turn (nulls first; ties by role, then the text's first 256
characters, then its hash). Per row an edit keeps it (0), gives it the role user or assistant (3) or
deletes it (4; the only one for a blank or duplicate row); empty user or assistant rows may be
inserted anywhere (3); a truncated row that stays adds 3. Wanted is the cheapest list of edits
after which the role initials are `(s?(ua)+)?`; of equally cheap ones that with the ASCII-least
initials of its edits (D, I, K, R).

Method: the state is what the repaired rows end with (nothing, s, u, a). Each state's best edits are a
node of a shared tree: its last edit, its parent, the rolling hash of the whole path and its
ancestors 1, 2, 4, … edits up. Two paths of equal cost are compared by a search for their longest common
prefix over ancestors of equal hash; that prefix is then verified edit by edit up to the node
they share, and where a collision is found the paths are compared in full. Two paths into one state
after the same row never have one a proper prefix of the other at equal cost, so a node's order is final.

Distribution: rows are range-partitioned by conversation and order, so a hot conversation is
spread over tasks, and sorted. A task repairs conversations that lie whole within it and within
one piece (`piece_rows` rows, `piece_bytes` bytes). Others are written as pieces. Their duplicates are
found by the first place of each (conversation, role, text hash); each piece is solved from every
state; one pass over a conversation's pieces, as rows without texts, chains them by the same tree with
a piece's edits as one node; then each piece is rewritten by itself. Only the digest of a
conversation's whole repaired text, which is sequential by nature, streams its pieces through one
task, one piece at a time.

Defined results: a conversation of no rows has zeros, an empty audit and the digest of the empty
string; a null conv_id is one conversation; a null role or text is one space, as are nulls in the hashed
`conv_id:turn`; an empty role has no initial. Rows equal in all columns are rows of their
own. Other columns are not read. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import checkpointed

SPACE = " \t\n\x0b\x0c\r"
PIECE_ROWS = 4096
PIECE_BYTES = 4 << 20
LEAD = 256

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_LEGAL = {"su", "ua", "au"}
_MOD = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E687 % _MOD


class Audits:
    """Edit lists as paths of a tree. A node: parent, label (edits as text), length in edits, level,
    rolling hash of the whole path, ancestors by powers of two."""

    def __init__(self) -> None:
        self.parent, self.label, self.length, self.hash = [-1], [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]
        self.level = [0]
        self.collisions = 0

    def add(self, node: int, label: str) -> int:
        h = self.hash[node]
        for c in label:
            h = (h * _BASE + ord(c)) % _MOD
        new = len(self.parent)
        self.parent.append(node)
        self.label.append(label)
        self.length.append(self.length[node] + len(label))
        self.level.append(self.level[node] + 1)
        self.hash.append(h)
        ups, at = [node], node
        while len(self.up[at]) >= len(ups):  # the 2^k-th ancestor's 2^k-th ancestor
            at = self.up[at][len(ups) - 1]
            ups.append(at)
        self.up.append(tuple(ups))
        return new

    def ancestor(self, node: int, level: int) -> int:
        while (gap := self.level[node] - level) > 0:
            node = self.up[node][gap.bit_length() - 1]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.label[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def _equal(self, a: int, b: int) -> bool:
        """Verify two paths of one hash, edit by edit, up to the node they share."""
        while a != b:
            if self.label[a] != self.label[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Is a's path before b's? Neither is a proper prefix of the other."""
        first, second = a, b
        low = min(self.level[a], self.level[b])
        a, b = self.ancestor(a, low), self.ancestor(b, low)
        if self._same(a, b):
            return self._in_full(first, second)
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and not self._same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        # a and b are the first that differ: what lies before them is the longest common prefix
        x, y = self.label[a], self.label[b]
        if not self._equal(self.parent[a], self.parent[b]) or x.startswith(y) or y.startswith(x):
            return self._in_full(first, second)
        return x < y

    def _same(self, a: int, b: int) -> bool:
        return self.hash[a] == self.hash[b] and self.length[a] == self.length[b]

    def _in_full(self, a: int, b: int) -> bool:
        self.collisions += 1
        return self.text(a) < self.text(b)


State = tuple[int, int]  # cost, node
States = list["State | None"]


def _better(t: Audits, old: State | None, cost: int, node: int, label: str) -> State:
    """The better of `old` and the path of `node` with `label` behind it."""
    if old is None or cost < old[0]:
        return cost, t.add(node, label)
    if cost == old[0]:
        new = t.add(node, label)
        if t.less(new, old[1]):
            return cost, new
    return old


def insert(t: Audits, states: States) -> States:
    """Rows inserted in front of the next one (more than two are never cheapest)."""
    out = list(states)
    for s in (START, SYSTEM, ASSISTANT):
        if states[s] is not None:
            out[USER] = _better(t, out[USER], states[s][0] + INSERT, states[s][1], "I")
    if out[USER] is not None:
        out[ASSISTANT] = _better(t, out[ASSISTANT], out[USER][0] + INSERT, out[USER][1], "I")
    return out


def advance(t: Audits, states: States, initial: str, forced: bool, truncated: bool) -> States:
    """The states after one more row."""
    states = insert(t, states)
    out: States = [None if s is None else (s[0] + DELETE, t.add(s[1], "D")) for s in states]
    if forced:
        return out
    more = TRUNCATED if truncated else 0
    if initial == "s" and states[START] is not None:
        out[SYSTEM] = _better(t, out[SYSTEM], states[START][0] + KEEP + more, states[START][1], "K")
    for s, to, own in ((START, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a")):
        if states[s] is not None:
            cost, label = (KEEP, "K") if initial == own else (REROLE, "R")
            out[to] = _better(t, out[to], states[s][0] + cost + more, states[s][1], label)
    return out


def finish(t: Audits, states: States) -> State:
    """Cost and path at the end of a conversation."""
    states = insert(t, states)
    best, a = states[START], states[ASSISTANT]
    if a is not None and (best is None or a[0] < best[0] or (a[0] == best[0] and t.less(a[1], best[1]))):
        best = a
    return best


def rewrite(audit: str, rows: list[tuple[str, str]], state: int) -> tuple[list[str], int]:
    """`role:text` of the repaired rows, and the state they end with."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        to = SYSTEM if edit == "K" and state == START and rows[i][0][:1] == "s" else ASSISTANT if state == USER else USER
        if edit == "K":
            out.append(f"{rows[i][0]}:{rows[i][1]}")
        else:
            out.append(f"{'assistant' if to == ASSISTANT else 'user'}:{rows[i][1] if edit == 'R' else ''}")
        i += edit != "I"
        state = to
    return out, state


def damaged(table: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows after damage; a dropped one stays as a mark of its conversation."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    d = table.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("kind"))
    changed = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("kind") == 0).alias("gone"), (F.col("kind") == 3).alias("twice"))
    return d.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "copy")


class Facts:
    """Counts over a run of rows in order, which can be joined to the run behind it."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def row(self, turn, role: str) -> None:
        if self.last is None:
            self.first = role[:1]
        elif self.last + role[:1] not in _LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, o: dict) -> None:
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, c, getattr(self, c) + o[c])
        if o["last"] is not None:
            if self.last is not None and self.last + o["first"] not in _LEGAL:
                self.illegal += 1
            self.last = o["last"]
        if o["high"] is not None:
            self.turns -= self.high is not None and self.high == o["low"]
            self.low = o["low"] if self.low is None else self.low
            self.high = o["high"]

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


def faults(rows: list[tuple[str, str]], duplicate: list[bool]) -> list[tuple[str, bool, bool, bool]]:
    """(initial, blank, duplicate, truncated) of each row; the first fault counts."""
    out = []
    for (role, text), twice in zip(rows, duplicate):
        end = text.rstrip(SPACE)
        out.append((role[:1], not end, bool(end) and twice, bool(end) and not twice and end[-1] not in ".!?"))
    return out


def count(facts: Facts, turns: list, rows: list[tuple[str, str]], marks: list) -> None:
    for turn, (role, _), (_, blank, twice, cut) in zip(turns, rows, marks):
        facts.row(turn, role)
        facts.blank += blank
        facts.duplicate += twice
        facts.truncated += cut


def repair(turns: list, rows: list[tuple[str, str]]) -> tuple[Facts, int, str, list[str]]:
    """Facts, cost, audit and repaired rows of one whole conversation in order."""
    seen: set = set()
    twice = []
    for r in rows:
        twice.append(r in seen)
        seen.add(r)
    marks = faults(rows, twice)
    facts = Facts()
    count(facts, turns, rows, marks)
    t = Audits()
    states: States = [(0, 0), None, None, None]
    for initial, blank, dup, cut in marks:
        states = advance(t, states, initial, blank or dup, cut)
    cost, node = finish(t, states)
    audit = t.text(node)
    return facts, cost, audit, rewrite(audit, rows, START)[0]


_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_RESULT = f"{_COUNTS}, audit string, repaired_sha256 string"


def _records(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _done(conv, f: Facts, cost: int, audit: str, digest: str) -> dict:
    return {"conv_id": conv, "gaps": f.gaps, "blank": f.blank, "duplicate": f.duplicate, "truncated": f.truncated, "illegal": f.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _arrow(spark_schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spark_schema))


def _pieces(ordered: DataFrame, conv_type: str, piece_rows: int, piece_bytes: int) -> DataFrame:
    """Sorted rows → finished conversations (`piece` null) and pieces of the others, numbered in order."""
    schema = f"conv_id {conv_type}, {_RESULT}, piece bigint, turns array<bigint>, roles array<string>, texts array<string>"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33  # ranges are numbered in their order
        conv, size, edge, begun = None, 0, True, False  # edge: the task's first conversation may have begun elsewhere
        turns: list = []
        rows: list[tuple[str, str]] = []
        out: list[dict] = []
        held = 0

        def close(last: bool, whole: bool) -> None:
            nonlocal number, turns, rows, size, held
            held += size
            if last and whole:
                f, cost, audit, lines = repair(turns, rows)
                out.append(_done(conv, f, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
            else:
                number += 1
                out.append({"conv_id": conv, "piece": number, "turns": turns, "roles": [r for r, _ in rows], "texts": [x for _, x in rows]})
            turns, rows, size = [], [], 0

        split = False  # has this conversation been cut already?
        for batch in batches:
            names = batch.schema.names
            for c, turn, role, text, gone in zip(*(batch.column(names.index(n)).to_pylist() for n in ("conv_id", "turn", "role", "text", "gone"))):
                if begun and c != conv:
                    close(True, not edge and not split)
                    edge = split = False
                elif begun and (len(rows) >= piece_rows or size >= piece_bytes):
                    close(False, False)
                    split = True
                conv, begun = c, True
                if not gone:
                    turns.append(turn)
                    rows.append((role, text))
                    size += len(text) + 32
                if len(out) >= 1024 or held > 8 << 20:
                    yield _records(out, arrow)
                    out, held = [], 0
        if begun:
            close(True, False)  # it may go on in the next task
        if out:
            yield _records(out, arrow)

    return ordered.mapInArrow(run, schema)


_FACTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, first string, last string, low bigint, high bigint"


def _solved(pieces: DataFrame, conv_type: str) -> DataFrame:
    """Of each piece its facts and, for each state it may begin and end with, cost and audit."""
    schema = f"conv_id {conv_type}, piece bigint, {_FACTS}, paths array<struct<a:int,b:int,cost:bigint,audit:string>>"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                rows = list(zip(r["roles"], r["texts"]))
                twice = [False] * len(rows)
                for k in r["again"] or ():
                    twice[k] = True
                marks = faults(rows, twice)
                f = Facts()
                count(f, r["turns"], rows, marks)
                paths = []
                for a in (START, SYSTEM, USER, ASSISTANT):
                    t = Audits()
                    states: States = [(0, 0) if s == a else None for s in range(4)]
                    for initial, blank, dup, cut in marks:
                        states = advance(t, states, initial, blank or dup, cut)
                    paths += [{"a": a, "b": b, "cost": s[0], "audit": t.text(s[1])} for b, s in enumerate(states) if s is not None]
                facts = {c: getattr(f, c) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")}
                yield _records([{"conv_id": r["conv_id"], "piece": r["piece"], **facts, "paths": paths}], arrow)

    return pieces.mapInArrow(run, schema)


def _chained(solved: DataFrame, conv_type: str) -> DataFrame:
    """Of each piece the state it begins with and its audit, the last one with the conversation's totals."""
    schema = f"conv_id {conv_type}, piece bigint, a int, part string, {_COUNTS}"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[pa.RecordBatch]:
            cost, node = finish(t, states)
            tail = ""
            while node and node not in begin:  # inserted behind the last row
                tail = t.label[node] + tail
                node = t.parent[node]
            chosen = []
            for p in reversed(numbers):
                chosen.append((p, begin[node], t.label[node]))
                node = t.parent[node]
            chosen.reverse()
            rows = [{"conv_id": conv, "piece": p, "a": a, "part": x} for p, a, x in chosen]
            done = _done(conv, f, cost, "", "")
            rows[-1] |= {c: done[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"part": rows[-1]["part"] + tail}
            for lo in range(0, len(rows), 256):
                yield _records(rows[lo : lo + 256], arrow)

        conv, numbers = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if not numbers or r["conv_id"] != conv:
                    if numbers:
                        yield from ended()
                    conv, numbers, f, t = r["conv_id"], [], Facts(), Audits()
                    states: States = [(0, 0), None, None, None]
                    begin: dict[int, int] = {}
                numbers.append(r["piece"])
                f.join(r)
                out: States = [None] * 4
                for path in r["paths"]:
                    a, b = path["a"], path["b"]
                    if states[a] is not None:
                        cost, node = states[a][0] + path["cost"], states[a][1]
                        if out[b] is None or cost <= out[b][0]:
                            new = t.add(node, path["audit"])
                            begin[new] = a
                            if out[b] is None or cost < out[b][0] or t.less(new, out[b][1]):
                                out[b] = cost, new
                states = out
        if numbers:
            yield from ended()

    ordered = solved.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(run, schema)


def _digests(pieces: DataFrame, conv_type: str) -> DataFrame:
    """Pieces with their parts of the audit → one row a conversation."""
    fragment = f"conv_id {conv_type}, piece bigint, part string, {_COUNTS}, body string, filled boolean"
    arrow = _arrow(fragment)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                lines = rewrite(r["part"], list(zip(r["roles"], r["texts"])), r["a"])[0]
                yield _records([{c: r[c] for c in ("conv_id", "piece", "part", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"body": "\n".join(lines), "filled": bool(lines)}], arrow)

    schema = f"conv_id {conv_type}, {_RESULT}"
    result = _arrow(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, parts, any_ = hashlib.sha256(), [], False
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["filled"]:
                    sha.update((("\n" if any_ else "") + r["body"]).encode())
                    any_ = True
                parts.append(r["part"])
                if r["cost"] is not None:  # the conversation's last piece
                    yield _records([{c: r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "".join(parts), "repaired_sha256": sha.hexdigest()}], result)
                    sha, parts, any_ = hashlib.sha256(), [], False

    bodies = pieces.mapInArrow(write, fragment)
    return bodies.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(digest, schema)


def audit(table: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    conv_type = table.schema["conv_id"].dataType.simpleString()
    rows = damaged(table.withColumn("turn", F.col("turn").cast("bigint")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, LEAD), F.xxhash64("text")]
    # the number of the row within its scan splits even equal rows among tasks; they can stand in any order
    keyed = rows.withColumn("_n", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order, "_n").sortWithinPartitions(*order, "_n").drop("_n")
    first = checkpointed(_pieces(ordered, conv_type, piece_rows, piece_bytes))
    whole = first.where("piece is null").select("conv_id", *[c.split()[0] for c in _RESULT.split(", ")])
    parts = first.where("piece is not null").select("conv_id", "piece", "turns", "roles", "texts")
    # duplicates across pieces: all but the first place of a role and text
    light = parts.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", F.transform("texts", lambda x: F.sha2(x, 256)).alias("hashes"))).alias("k", "z"))
    light = light.select("conv_id", "piece", "k", F.col("z.roles").alias("role"), F.col("z.hashes").alias("h"))
    earliest = light.groupBy("conv_id", "role", "h").agg(F.min(F.struct("piece", "k")).alias("earliest"))
    same = light["conv_id"].eqNullSafe(earliest["conv_id"]) & (light["role"] == earliest["role"]) & (light["h"] == earliest["h"])
    later = light.join(earliest, same).where(F.struct(light["piece"], light["k"]) > F.col("earliest"))
    again = later.groupBy(light["piece"].alias("piece")).agg(F.collect_list(light["k"]).alias("again"))  # at most piece_rows
    marked = checkpointed(parts.join(again, "piece", "left"))
    chained = _chained(_solved(marked, conv_type), conv_type).drop("conv_id")
    return whole.unionByName(_digests(marked.drop("again").join(chained, "piece"), conv_type))
