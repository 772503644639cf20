import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from busline.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, edits) by a shortest path over (rows consumed, roles so far fit to be continued); rows are (initial, fault)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        heapq.heappush(heap, (cost + 3, audit + "I", at, "a" if last == "u" else "u"))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last))
            if fault in ("none", "truncated"):
                more = 3 * (fault == "truncated")
                if initial and initial in after:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initial))
                heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, "a" if last == "u" else "u"))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
        out += [(conv, turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return out


def brute(rows):
    """Audit rows of ``turns.repair`` in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(
            f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, marked = set(), []
        for _, role, text in mine:
            bare = text.rstrip(turns.SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated"
            marked.append((role[:1], fault))
            seen.add((role, text))
        cost, audit = cheapest(marked)
        told, at, last = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else mine[at][1:]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                told.append(f"{role}:{text}")
        assert FORM.fullmatch("".join(t[:1] for t in told))
        known = {r[0] for r in mine if r[0] is not None}
        count = [sum(f == name for _, f in marked) for name in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:], strict=False))
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *count, illegal, cost, audit,
                     hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def conversations(rng):
    texts = ["Yes.", "no", "Well? ", "", " \n", "Ü!", "日本", None, "End. ", "x" * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "uncle"]
    rows = []
    for conv in [None, *range(60)]:
        kinds = roles if rng.random() < 0.4 else roles[:3]
        rows += [(conv, None if rng.random() < 0.1 else rng.randint(0, 12), rng.choice(kinds), rng.choice(texts)) for _ in range(rng.randint(1, 14))]
    # a conversation with most of the rows, long runs in it, and one that alternates as it should
    rows += [(99, k, "user" if k % 97 else "assistant", f"{k}.") for k in range(300)]
    rows += [(98, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(80)]
    return rows + rows[:40]


def test_matrices_and_choices_equal_shortest_paths():
    rng = random.Random(3)
    names = {"-": "none", "t": "truncated", "x": "blank"}
    for n in [0, 1, 2, 3, 5, 8, 13, 40] * 30:
        symbols = "".join(rng.choice(list(turns.SYMBOLS)) * rng.choice([1, 1, 2, 9]) for _ in range(n))
        rows = [(turns.SYMBOLS[x][0], names[turns.SYMBOLS[x][1]]) for x in symbols]
        cost, audit = cheapest(rows)
        assert turns.onto(turns.summed(symbols), turns.CLOSE)[turns.START] == cost
        assert turns.unroll(symbols, turns.CLOSE, True, range(1))[0][0] == audit


@pytest.mark.parametrize("chunk", [3, 4096])
def test_repair_equals_plain_python(spark, monkeypatch, chunk):
    monkeypatch.setattr(turns, "CHUNK", chunk)
    rows = conversations(random.Random(chunk))
    clash = [F.lit("x").alias(c) for c in ("c", "number", "same", "blank", "cut", "fault", "initial", "chunk", "symbols", "audit", "c_", "number_", "sub", "edit", "hit", "copy")]
    hurt = queries.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("*", *clash)
    audit, fixed = turns.repair(hurt)
    got = {r[0]: tuple(r)[1:] for r in audit.collect()}
    assert got == brute(damaged(rows))
    lines = {}
    for r in sorted(fixed.collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in lines.items()} == {
        c: v[-1] for c, v in got.items() if v[-1] != hashlib.sha256().hexdigest()}


def test_query_returns_every_conversation(spark, tmp_path):
    rows = [(1, k, "user", "Hello.") for k in range(40) if zlib.crc32(f"1:{k}".encode()) % 20 == 0] + [(2, 0, "user", "Hi."), (None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.QUERIES["op13_turn_repair"](spark, f"{tmp_path}/none").count() == 0
