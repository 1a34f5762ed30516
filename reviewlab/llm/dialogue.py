"""Repair of conversations by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn, so that each task reads its
conversations one after the other, a row at a time.  What it carries from row
to row, and over Arrow batches, doesn't grow with a conversation: four states,
each with the cost and the running hash of its cheapest repair, and counters.
One backpointer of two bytes a row goes to a buffer that spills to the task's
own scratch file when a conversation is very long; the end of a conversation
reads it backwards.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What counts as blank.
BLANK = " \t\n\x0b\x0c\r"
#: Backpointers of a conversation are held in memory up to these bytes.
HELD = 1 << 22
#: Rows of backpointers written or read at once.
AT_ONCE = 1 << 15
#: Characters of results after which a task passes them on.
PASS_ON = 1 << 22

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
CUT_OFF = 1  # what a truncated row costs if it stays
#: States by what the repaired rows so far are: none, a system row, ending with a user, with an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: b"user:", ASSISTANT: b"assistant:"}
#: Edits that complete each state, and their cost.
ENDS = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FAR = 1 << 40
#: From each state every other's further edits can be done for at most so much more (insert up to two,
#: delete one row instead of keeping it), so a state beyond that never wins.
HOPELESS = 8


def candidates(state: int, initial: str, fault: str):
    """(next state, edits, cost) for a row met in a state.

    An insertion before a deletion is never the best of ties, as the deletion
    may come first; no repair needs more than one insertion before a row.
    """
    yield state, "D", DELETE
    if fault in "bd":
        return
    more = CUT_OFF if fault == "t" else 0
    if initial == "s" and state == NONE:
        yield SYSTEM, "K", KEEP + more
    for target in (USER, ASSISTANT):
        direct = (state == USER) == (target == ASSISTANT)
        before, price = ("", 0) if direct else ("I", INSERT)
        if initial == ("u" if target == USER else "a"):
            yield target, before + "K", price + KEEP + more
        yield target, before + "R", price + REROLE + more


MOVES: list[tuple] = []


@cache
def step(costs: tuple, order: tuple, initial: str, fault: str) -> tuple:
    """One row from all states: (cost added to all, costs, order, number of the moves).

    costs are above the least one.  order ranks the states' edits as text: no
    state's edits begin another's, as all hold the same number of rows, so
    ranks and the new edits decide ties.  Few arguments occur, hence the cache.
    """
    best: dict[int, tuple] = {}
    for state, cost in enumerate(costs):
        if cost < FAR:
            for to, edits, price in candidates(state, initial, fault):
                one = (cost + price, order[state], edits, state)
                if to not in best or one < best[to]:
                    best[to] = one
    least = min(b[0] for b in best.values())
    best = {s: b for s, b in best.items() if b[0] <= least + HOPELESS}
    ranks = {b: i for i, b in enumerate(sorted(x[1:3] for x in best.values()))}
    moves = tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))
    if moves not in MOVES:
        MOVES.append(moves)
    return (least, tuple(best[s][0] - least if s in best else FAR for s in range(4)),
            tuple(ranks[best[s][1:3]] if s in best else 0 for s in range(4)), MOVES.index(moves))


def hashed(digest, started: bool, lines: list[bytes]):
    """The hash with further lines; the old one stays as it is."""
    new = digest.copy()
    new.update((b"\n" if started else b"") + b"\n".join(lines))
    return new


class Conversation:
    """The state of the conversation being read."""

    def __init__(self, key):
        self.key = key
        self.total, self.costs, self.order = 0, (0, FAR, FAR, FAR), (0, 0, 0, 0)
        self.digests = [hashlib.sha256()] * 4
        self.back, self.spilled = array("H"), tempfile.SpooledTemporaryFile(HELD)
        self.counts = dict.fromkeys("bdt", 0)
        self.illegal, self.before = 0, None
        self.first = self.last = None
        self.turns = 0

    def row(self, turn: str | None, role: str, text: str, fault: str) -> None:
        if turn is not None and (number := int(turn)) != self.last:
            self.first, self.last, self.turns = number if self.first is None else self.first, number, self.turns + 1
        if fault != "k":
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        added, self.costs, self.order, moves = step(self.costs, self.order, initial if initial in ("s", "u", "a") else "", fault)
        self.total += added
        body = text.encode("utf-8", "surrogatepass")
        old = self.digests
        self.digests = list(old)
        for to, move in enumerate(MOVES[moves]):
            if move is None:
                continue
            state, edits = move
            if edits == "D":
                self.digests[to] = old[state]
                continue
            lines = [NAMES[USER + ASSISTANT - to]] if edits[0] == "I" else []
            lines.append((role.encode("utf-8", "surrogatepass") + b":" if edits[-1] == "K" else NAMES[to]) + body)
            self.digests[to] = hashed(old[state], state != NONE, lines)
        self.back.append(moves)
        if len(self.back) >= AT_ONCE:
            self.spill()

    def spill(self) -> None:
        self.spilled.write(self.back.tobytes())
        self.back = array("H")

    def edits(self, state: int) -> str:
        """The edits that lead to a state, read backwards."""
        out = []
        width = self.back.itemsize

        def walked(moves):
            nonlocal state
            for m in reversed(moves):
                state, edits = MOVES[m][state]
                out.append(edits[::-1])
        walked(self.back)
        at = self.spilled.tell()
        while at:
            size = min(at, AT_ONCE * width)
            at -= size
            self.spilled.seek(at)
            walked(array("H", self.spilled.read(size)))
            out = ["".join(out)]
        return "".join(out)[::-1]

    def result(self) -> tuple:
        ending = {s: c + INSERT * len(ENDS[s]) for s, c in enumerate(self.costs) if c < FAR}
        state = min(ending, key=lambda s: (ending[s], self.order[s]))
        digest = self.digests[state]
        if ENDS[state]:
            digest = hashed(digest, True, [NAMES[USER], NAMES[ASSISTANT]][-len(ENDS[state]):])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        out = (self.key, gaps, *self.counts.values(), self.illegal, self.total + ending[state], self.edits(state) + ENDS[state], digest.hexdigest())
        self.spilled.close()
        return out


RESULT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def streamed(batches):
    """Sorted rows of a task (conv, present, turn, role, text, fault) to one result per conversation."""
    now, done, size = None, [], 0
    for batch in batches:
        for conv, present, turn, role, text, fault in zip(*(batch[c] for c in ("conv", "present", "turn", "role", "text", "fault"))):
            if now is None or conv != now.key:
                if now is not None:
                    done.append(now.result())
                    size += len(done[-1][-2]) + 200
                    if size > PASS_ON:
                        yield pd.DataFrame(done, columns=RESULT)
                        done, size = [], 0
                now = Conversation(conv)
            if present:
                now.row(turn, role, text, fault)
    if now is not None:
        done.append(now.result())
    if done:
        yield pd.DataFrame(done, columns=RESULT)


def readable(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """(conv, present, turn, role, text, fault) dealt by conversation, sorted by turn (nulls first), role, text."""
    src = rows.select(F.col(conv).alias("conv"), present.alias("present"), F.col(turn).cast("long").alias("turn"),
                      F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    body = F.rtrim("text", F.lit(BLANK))
    seen = F.row_number().over(W.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = (F.when(body == "", "b").when(F.col("seen") > 1, "d")
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "t").otherwise("k"))
    # the window is satisfied by the rows' dealing: one shuffle in all
    return (src.repartition("conv").withColumn("seen", seen).withColumn("fault", fault)
            .sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "seen"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """Faults and the cheapest repair of each conversation, one row per conversation.

    Result: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).
    A row's first fault counts: blank (white space only), duplicate (role and text seen earlier in
    the conversation), truncated (the last character that isn't white space is none of ".!?").  gaps:
    turn numbers missing between the least and the greatest.  illegal: neighbours whose role initials are not
    su, ua or au.  A repair keeps (0), reroles to user or assistant (2) or deletes (3, required of blank and
    duplicate rows) each row, may insert empty user or assistant rows (2) and pays 1 for each truncated row that stays;
    the initials of what is left are none, or an optional s and then pairs of u and a.  audit: the
    edits' initials of the cheapest repair, of several the least as ASCII text; repaired_sha256: of the repaired rows, written
    `role:text` and joined by newlines.

    Nulls: a null role or text is one space, rows with a null conversation are one conversation, rows with a null
    turn come first and count for no gap.  Rows with equal turns are ordered by role and text; repeated rows are duplicates.
    Rows for which `present` is false only name their conversation; one without other rows has zeros, an empty
    audit and the hash of the empty string.  An empty table gives no rows; other columns are ignored, whatever their names.

    One conversation is read by one task, as its hash needs its texts in order; the task's memory holds
    a row and one byte or two of audit per row, not the conversation.
    """
    kind = rows.schema[conv].dataType
    sorted_rows = readable(rows, conv, turn, role, text, F.lit(True) if present is None else present)
    # keys as text: pandas has no integers with nulls
    plain = sorted_rows.select(F.col("conv").cast("string").alias("conv"), "present", F.col("turn").cast("string").alias("turn"), "role", "text", "fault")
    out = plain.mapInPandas(streamed, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.select(F.col("conv").cast(kind).alias(conv), *RESULT[1:])


def repaired(rows: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations' rows: (conv, position from 1, edit, turn, role, text).

    found is repair()'s result for the same rows.  Deleted rows are left out; inserted ones have a null turn.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    src = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                      F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    src = src.withColumn("n", F.row_number().over(W.partitionBy("conv").orderBy(*order)))
    at = W.partitionBy("conv").orderBy("at")
    edits = (found.select(F.col(conv).alias("conv"), F.posexplode(F.split(F.substring("audit", 1, 1 << 30), "")).alias("at", "edit")).where("edit <> ''")
             .withColumn("n", F.sum(F.when(F.col("edit") != "I", 1).otherwise(0)).over(at))
             .where("edit <> 'D'").withColumn("position", F.row_number().over(at)))
    edits = edits.withColumn("n", F.when(F.col("edit") != "I", F.col("n")))
    both = edits.alias("e").join(src.alias("s"), F.col("e.conv").eqNullSafe(F.col("s.conv")) & (F.col("e.n") == F.col("s.n")), "left")
    led = F.max(F.when((F.col("e.position") == 1) & (F.col("edit") == "K") & (F.substring("s.role", 1, 1) == "s"), 1).otherwise(0)).over(W.partitionBy("e.conv"))
    turns = both.select(F.col("e.conv").alias(conv), "e.position", "edit", "s.turn", F.col("s.role").alias("was"), "s.text", led.alias("led"))
    due = F.when((F.col("position") - F.col("led")) % 2 == 1, "user").otherwise("assistant")
    return turns.select(conv, "position", "edit", F.col("turn").alias(turn), F.when(F.col("edit") == "K", F.col("was")).otherwise(due).alias(role),
                        F.coalesce("text", F.lit("")).alias(text))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, Column]:
    """Rows with faults planted by crc32(`conv:turn`) modulo 20, and whether a row is present.

    0 drops the row (it stays as one that isn't present, so that its conversation does), 1 empties its text, 2 removes
    its ".!?", 3 repeats it, 4 makes it the user's.  A null is one space, in the key too.
    """
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")), F.lit(20))
    out = rows.select(
        F.col(conv), F.col(turn), kind.alias("kind"), F.when(kind == 4, "user").otherwise(shown(role)).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.translate(shown(text), ".!?", "")).otherwise(shown(text)).alias(text))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))), F.col("kind") != 0
