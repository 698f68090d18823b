"""Repair against an exhaustive search over edit strings, with whole conversations and with small windows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from smframe.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Of all edit strings by (cost, string), the first that gives a valid conversation: a search with a heap, no states of roles."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        roles = "".join(o[0][:1] or "-" for o in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, [":".join(o) for o in out]
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        key = (i, roles[-1:])
        if key in done:
            continue
        done.add(key)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if fault in (0, 3):
                heapq.heappush(heap, (cost + (fault == 3), audit + "K", i + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + (fault == 3), audit + "R", i + 1, (*out, (new, text))))


def reference(table):
    """The contract, conversation by conversation."""
    out = {}
    sp = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
            role, text = sp(role), sp(text)
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(cr.BLANK)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        roles = [r[1][:1] for r in rows]
        cost, audit, lines = brute([(r[1], r[2], f) for r, f in zip(rows, faults)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len({*turns}) if turns else 0, *(faults.count(k) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, count, longest):
    r, out = random.Random(seed), []
    for conv in [None, *range(count)]:
        for k in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "assistant", "user", "system", "tool", "User", "", None])
            role = ["user", "assistant"][k % 2] if r.random() < 0.6 else role
            out.append((conv, r.choice([k, k, k, k + r.randint(0, 3), None]), role, r.choice(["Yes.", "No!", "why?", "cut off", "", " \n", None, "Same.", f"line {k}.", f"é {k}? \t"])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("window", [3, 64, 16_384])
def test_equals_exhaustive_search(spark, window):
    table = conversations(5, 120, 12) + [(1000, k, ["user", "assistant"][k % 2] if k % 7 else "tool", f"turn {k}{'.' * (k % 5 > 0)}") for k in range(200)]
    got = {r[0]: tuple(r)[1:] for r in cr.repair(spark.createDataFrame(table, SCHEMA).repartition(3), window).collect()}
    want = reference(table)
    assert got == want
    assert any("I" in v[6] for v in want.values()) and any("R" in v[6] for v in want.values()) and any(v[6] == "" for v in want.values())


def test_a_long_conversation_leaves_memory_in_windows(spark, monkeypatch):
    """Of a conversation of 5,000 turns no window holds much more than its size."""
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, parts = cr.repair(df, 100_000).collect(), cr.repair(df, 64).collect()
    assert whole == parts and len(whole[0]["audit"]) > 4000


def test_settled_rows_are_those_of_the_best_path():
    """Whatever follows a window, its settled rows have the edits that the whole has."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(1)
    for _ in range(60):
        n = int(r.integers(2, 30))
        t = pa.table({"initial": r.integers(0, 4, n), "fault": r.choice([0, 0, 0, 1, 2, 3], n), "turn": [*range(n)], "role": ["x"] * n, "text": ["y"] * n})
        rows, cut = cr.Rows(t), int(r.integers(1, n))
        whole, part = cr.Repair(1), cr.Repair(1)
        cr.repaired([(whole, rows)])
        done = cr.settle(part, cr.Rows(t.slice(0, cut)))
        cr.repaired([(part, cr.Rows(t.slice(done)))])
        assert whole.row() == part.row()


def test_empty_table_and_clashing_columns(spark):
    assert cr.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    table = conversations(9, 10, 5)
    plain = spark.createDataFrame(table, SCHEMA)
    more = plain.selectExpr("*", "'x' as gone", "1 as k", "2 as kind", "3 as fault", "4 as `a.b`", "'z' as audit")
    assert sorted(map(str, cr.repair(more).collect())) == sorted(map(str, cr.repair(plain).collect()))
