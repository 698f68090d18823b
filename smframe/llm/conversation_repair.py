"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

A conversation is a path through four states (nothing yet, behind a system, a user, an assistant turn). Conversations
are bucketed by length; a tensor turn x conversation x state holds the least cost from each state to the end, filled
backwards one turn at a time for all conversations of the bucket at once. Edits are traced forwards in the same way:
of those that keep the cost least, the first in ASCII order, which gives the least audit string.

Edits: Delete 3 (the only one for blank and duplicate rows), Insert an empty turn 2, Keep 0, Rerole 2; a truncated row that
stays adds 1. An inserted or reroled turn takes the role that is due: assistant behind a user, else user.

One shuffle deals conversations to tasks and Spark sorts them there, on disk where need be; a task holds some
ten thousand rows. A longer conversation passes in windows: once the best paths to all states that can be reached at a window's
end agree on their first rows, those are settled and leave memory, so it is repaired exactly all the same. Its
digest is a chain over its texts in order, so one conversation does stay in one task.

Rows are taken by turn, nulls first, rows of one turn by role and text. A null role or text is one space. A null
conv_id is one conversation. Repeated rows are duplicates. A table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLANK = " \t\n\x0b\x0c\r"
NONE, BLANKED, DUPLICATE, TRUNCATED = range(4)
#: States and roles: 0 nothing yet (as a role: any other), 1 system, 2 user, 3 assistant. Where the role that is due leads:
DUE = np.array([2, 2, 3, 2])
#: [role, state]: whether a row of that role may stay as it is.
FITS = np.zeros((4, 4), bool)
FITS[1, 0] = FITS[2, [0, 1, 3]] = FITS[3, 2] = True
END = np.array([0, 1 << 28, 1 << 28, 0], np.int32)
DELETE, KEEP, REROLE = 0, 1, 2
COST = {"D": 3, "I": 2, "K": 0, "R": 2}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of all rows, changed by the CRC-32 of conv_id:turn; dropped rows stay as gone, without a text."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    d = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 0, F.lit("")).when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def solve(role: np.ndarray, fault: np.ndarray, length: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, inserts, states), time-major: of each row its edit, the turns inserted before it and the state before those.

    role, fault: (turns, conversations); length, start: of each conversation; end: (conversations, states), the cost of
    stopping in a state. inserts and states have one more row: what comes behind the last turn.
    """
    turns, n = role.shape
    each = np.arange(n)
    least = np.empty((turns + 1, n, 4), np.int32)

    def inserted(x: np.ndarray) -> np.ndarray:
        return np.minimum(x, COST["I"] + np.minimum(x, COST["I"] + x[:, DUE])[:, DUE])

    stays = np.where(fault == TRUNCATED, 1, np.where(fault == NONE, 0, 1 << 28)).astype(np.int32)
    least[turns] = inserted(end.astype(np.int32))
    for t in range(turns - 1, -1, -1):
        after, add = least[t + 1], stays[t][:, None]
        due = after[:, DUE]
        # a kept row leads to the state of its role; one of any other role never fits
        keep = np.where(FITS[role[t]], add + after[each, role[t]][:, None], 1 << 28)
        now = inserted(np.minimum(np.minimum(after + COST["D"], keep), COST["R"] + add + due))
        least[t] = np.where((t < length)[:, None], now, after)
    edits, inserts, states = np.zeros((turns, n), np.uint8), np.zeros((turns + 1, n), np.uint8), np.zeros((turns + 1, n), np.uint8)
    s = start.astype(np.int64)
    for t in range(turns + 1):
        states[t] = s
        for _ in range(2):
            best, more = least[t][each, s], t <= length
            if t < turns:
                more = more & ~((t < length) & (least[t + 1][each, s] + COST["D"] == best))
            more = more & (least[t][each, DUE[s]] + COST["I"] == best) & (best < 1 << 28)
            if not more.any():
                break
            inserts[t] += more
            s = np.where(more, DUE[s], s)
        if t == turns:
            break
        best, live = least[t][each, s], t < length
        delete = live & (least[t + 1][each, s] + COST["D"] == best)
        keep = live & ~delete & FITS[role[t], s] & (stays[t] + least[t + 1][each, role[t]] == best)
        edits[t] = np.where(delete, DELETE, np.where(keep, KEEP, REROLE))
        s = np.where(delete | ~live, s, np.where(keep, role[t], DUE[s]))
    return edits, inserts, states


@dataclass
class Repair:
    """What is known of a conversation so far."""

    conv_id: int | None
    state: int = 0
    counts: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    illegal: int = 0
    last_role: int = -1
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    cost: int = 0
    audit: list[str] = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    written: bool = False

    def seen(self, turn: list[int | None], role: np.ndarray, fault: np.ndarray) -> None:
        """Counts of rows before repair."""
        self.counts += np.bincount(fault, minlength=4)
        r = role if self.last_role < 0 else np.append(self.last_role, role)
        a, b = r[:-1], r[1:]
        self.illegal += int(np.count_nonzero(~(((a == 1) | (a == 3)) & (b == 2) | (a == 2) & (b == 3))))
        self.last_role = int(role[-1]) if len(role) else self.last_role
        for t in turn:
            if t is not None and t != self.last_turn:
                self.first_turn = t if self.first_turn is None else self.first_turn
                self.last_turn, self.turns = t, self.turns + 1

    def write(self, roles: list[str], texts: list[str], fault: np.ndarray, edits: np.ndarray, inserts: np.ndarray, role: np.ndarray) -> None:
        """Takes the edits of some rows in order, and the inserts before each; inserts may have one more, behind the last."""
        lines, audit, s = [], [], self.state
        rows = zip(edits.tolist(), fault.tolist(), role.tolist(), roles, texts)
        for k, n in enumerate(inserts.tolist()):
            for _ in range(n):
                lines.append("assistant:" if s == 2 else "user:")
                audit.append("I")
                s = int(DUE[s])
            if k == len(edits):
                break
            edit, f, own, name, text = next(rows)
            if edit == DELETE:
                audit.append("D")
                continue
            if edit == KEEP:
                audit.append("K")
                s = own
            else:
                audit.append("R")
                name = "assistant" if s == 2 else "user"
                s = int(DUE[s])
            self.cost += f == TRUNCATED
            lines.append(f"{name}:{text}")
        self.state = s
        self.cost += sum(COST[x] for x in audit)
        self.audit.append("".join(audit))
        if lines:
            self.digest.update(("\n" * self.written + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            self.written = True

    def row(self) -> tuple:
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, (1 << 63) - 1)
        return (self.conv_id, gaps, *self.counts[1:].tolist(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


SCHEMA = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


class Rows:
    """Consecutive rows that aren't gone, as arrays and lists."""

    def __init__(self, t: pa.Table):
        self.role, self.fault = t["initial"].to_numpy().astype(np.int64), t["fault"].to_numpy().astype(np.int64)
        self.turn, self.roles, self.texts = t["turn"].to_pylist(), t["role"].to_pylist(), t["text"].to_pylist()


def repaired(whole: list[tuple[Repair, Rows]]) -> list[tuple]:
    """The results of conversations whose last rows these are; those of like length go through the tensors together."""
    for k in {len(r.role).bit_length() for _, r in whole}:
        bucket = [x for x in whole if len(x[1].role).bit_length() == k]
        length = np.array([len(r.role) for _, r in bucket])
        role, fault = np.zeros((length.max(), len(bucket)), np.int64), np.zeros((length.max(), len(bucket)), np.int64)
        for i, (_, r) in enumerate(bucket):
            role[: length[i], i], fault[: length[i], i] = r.role, r.fault
        edits, inserts, _ = solve(role, fault, length, np.array([c.state for c, _ in bucket]), np.tile(END, (len(bucket), 1)))
        for i, (c, r) in enumerate(bucket):
            n = length[i]
            c.seen(r.turn, r.role, r.fault)
            c.write(r.roles, r.texts, r.fault, edits[:n, i], inserts[: n + 1, i], r.role)
    return [c.row() for c, _ in whole]


def settle(c: Repair, r: Rows) -> int:
    """Writes those first rows of a conversation whose edits are the same whatever follows; how many there were."""
    n, ends = len(r.role), np.full((4, 4), 1 << 28)
    np.fill_diagonal(ends, 0)
    role, fault = np.repeat(r.role[:, None], 4, 1), np.repeat(r.fault[:, None], 4, 1)
    edits, inserts, states = solve(role, fault, np.full(4, n), np.full(4, c.state), ends)
    last = np.array([reached(states[n, e], inserts[n, e]) for e in range(4)])
    able = np.flatnonzero(last == np.arange(4))  # ends that can be reached at all
    same = (edits[:, able] == edits[:, able[:1]]).all(1) & (inserts[:n, able] == inserts[:n, able[:1]]).all(1)
    k = n if same.all() else int(np.argmin(same))
    if k:
        c.seen(r.turn[:k], r.role[:k], r.fault[:k])
        c.write(r.roles[:k], r.texts[:k], r.fault[:k], edits[:k, able[0]], inserts[:k, able[0]], r.role[:k])
    return k


def reached(state: int, inserts: int) -> int:
    for _ in range(inserts):
        state = DUE[state]
    return int(state)


def repair(conversations: DataFrame, window: int = 16_384) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage.

    window: rows that a task takes at once.
    """
    d = damaged(conversations).repartition("conv_id")
    alike = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    last = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    first = F.substring("role", 1, 1)
    d = d.withColumn("k", F.row_number().over(alike)).select(
        "conv_id", "turn", "role", "text", "gone",
        F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0).alias("initial"),
        F.when(last == "", BLANKED).when(F.col("k") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(NONE).alias("fault"),
    )
    d = d.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, load, limit, open_ = [], 0, window, None

        def weight(x: pa.RecordBatch | pa.Table) -> int:
            return x.num_rows + (x.nbytes >> 11)

        def take(final: bool) -> Iterator[pa.RecordBatch]:
            """Repairs the conversations that are complete; keeps the last one's rows, or what isn't settled of them."""
            nonlocal held, load, limit, open_
            t = pa.Table.from_batches(held)
            ids, known = t["conv_id"].fill_null(0).to_numpy(), t["conv_id"].is_valid().to_numpy()
            starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1]))) if len(ids) else np.zeros(0, np.int64)
            whole, rest = [], t.slice(0, 0)
            if open_ and not (len(ids) and t["conv_id"][0].as_py() == open_.conv_id):  # it had ended with what is settled
                whole.append((open_, Rows(rest)))
                open_ = None
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                part = t.slice(i, j - i)
                part = part.filter(pc.invert(part["gone"]))
                c, open_ = open_ or Repair(t["conv_id"][i].as_py()), None
                if j < len(ids) or final:
                    whole.append((c, Rows(part)))
                else:
                    done = settle(c, Rows(part)) if len(starts) == 1 and len(part) else 0
                    rest, open_ = part.slice(done), c
            held, load = rest.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], t.schema)], weight(rest)
            limit = max(window, 2 * load)
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*repaired(whole)), SCHEMA)], schema=SCHEMA)

        for b in batches:
            for k in range(0, b.num_rows, window):
                held.append(b.slice(k, window))
                load += weight(held[-1])
                if load >= limit:
                    yield from take(False)
        if held:
            yield from take(True)

    return d.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
