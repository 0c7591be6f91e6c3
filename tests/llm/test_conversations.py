from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest

from pagemill.llm import conversations as C
from pagemill.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(table):
    """conv_id → result, from the contract: edits are chosen from the back, where the first one decides a tie."""
    convs = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows = [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        convs.setdefault(conv, []).extend(rows)
    out = {}
    for conv, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, fault = set(), []
        for _, role, text in rows:
            word = re.sub("[\x20\x09-\x0d]", "", text)
            fault.append("blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]

        @functools.cache
        def best(i, end, room):
            """(cost, audit) from row i on; `end`: what stands before; room: inserts still tried here."""
            got = []
            if i == len(rows) and end in ("", "a"):
                got.append((0, ""))
            if room and end in ("", "s", "a"):
                got.append(tuple(x + y for x, y in zip((3, "I"), best(i, "u", room - 1))))
            if room and end == "u":
                got.append(tuple(x + y for x, y in zip((3, "I"), best(i, "a", room - 1))))
            if i < len(rows):
                got.append(tuple(x + y for x, y in zip((4, "D"), best(i + 1, end, 3))))
                if fault[i] not in ("blank", "duplicate"):
                    more = 3 if fault[i] == "truncated" else 0
                    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[end]
                    if initials[i] and initials[i] in nexts:
                        got.append(tuple(x + y for x, y in zip((more, "K"), best(i + 1, initials[i], 3))))
                    for to in nexts.replace("s", ""):
                        got.append(tuple(x + y for x, y in zip((3 + more, "R"), best(i + 1, to, 3))))
            return min(got, default=(10**9, ""))

        for i in range(len(rows), -1, -1):  # from the back, or the recursion gets too deep
            for end in ("", "s", "u", "a"):
                best(i, end, 3)
        cost, audit = best(0, "", 3)
        lines, i, end = [], 0, ""
        for e in audit:
            if e in "IR":
                end = "a" if end == "u" else "u"
                lines.append(f"{'user' if end == 'u' else 'assistant'}:{rows[i][2] if e == 'R' else ''}")
            elif e == "K":
                end = initials[i]
                lines.append(f"{rows[i][1]}:{rows[i][2]}")
            i += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op11_conversations"](spark, sf)) == brute(table)


def messy(n, seed, convs=40):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        conv = r.choice([1] * 20 + [None, *range(2, convs)])  # conversation 1 holds a third of all rows
        role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "umpire", "", None])
        rows.append((conv, r.choice([None, *range(-3, 60)]), role, r.choice([None, "", " \t", "a.", "b", "c!  ", "x?\n", "y z.", " ", f"t{r.randrange(50)}."])))
    return rows


@pytest.mark.parametrize(("piece", "seed"), [(4096, 1), (7, 2), (3, 3), (1, 4)])
def test_pieces_of_any_size_give_the_same(spark, piece, seed):
    rows = messy(700, seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(C.audit(table, piece_rows=piece)) == brute(rows)


def test_edges(spark):
    rows = [(1, 5, "user", "x" * 300000 + "."), (1, 6, "assistant", "ok."), (2, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (3, 2, "user", "aé.\x00b.")]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA + ", piece string, part int")
    assert result(C.audit(table, piece_bytes=1000)) == brute(rows)
    assert C.audit(table.limit(0)).collect() == []


def test_equal_rows_are_split_among_tasks(spark):
    rows = [(7, 3, "user", "same.")] * 300 + [(7, 4, "assistant", "b.")]
    assert result(C.audit(spark.createDataFrame(rows, SCHEMA).repartition(4), piece_rows=20)) == brute(rows)


def test_paths_compare_as_their_texts_also_under_collisions(monkeypatch):
    for base in (C._BASE, 1):  # with base 1 every reordering of edits collides
        monkeypatch.setattr(C, "_BASE", base)
        r, t = random.Random(5), C.Audits()
        nodes = [0]
        for _ in range(600):
            nodes.append(t.add(r.choice(nodes[-40:]), r.choice("DIKR")))
        for _ in range(4000):
            a, b = r.choice(nodes), r.choice(nodes)
            x, y = t.text(a), t.text(b)
            if not x.startswith(y) and not y.startswith(x):
                assert t.less(a, b) == (x < y)
        assert (t.collisions > 0) == (base == 1)
