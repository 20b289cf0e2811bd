"""Repair of conversations: the cheapest edits that make a conversation's roles follow the grammar `(s?(ua)+)?`.

Rows of a conversation are taken by turn (nulls first), ties by role, then text. A row's first fault counts: blank (no
character but space and U+0009-U+000D), duplicate (role and text stood earlier), truncated (the last other character is
not one of `.!?`). Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate
rows), Insert an empty user or assistant turn 5; a truncated row that stays costs 5 more. Of the cheapest edits the one
whose string of initials is least wins.

Forward Viterbi over the four states of the grammar (start, after system, after user, after assistant). Each state
carries its least (cost, audit string); after every row the layer is closed by at most two inserts, as no two states are
further apart. Two audits of equal cost at one layer are never prefixes of one another, because the string and the rows
determine the cost, so taking the least string early is exact. What all live states share of their audits is settled: it
is written out and forgotten, so a task holds the unsettled rows only. The rows of a conversation stream, sorted, through
one task, since both the automaton and the digest of the repaired text are sequential; only the settled audit grows with
it. Whether a text stood earlier is found before, by a grouped minimum over digests, whose groups combine before the
shuffle.

Nulls: role and text are one space then (so such a text is blank); a null turn sorts first and is left out of `gaps`; rows
without conv_id are one conversation. Repeated rows are duplicates. Very long texts travel whole. An empty table gives no
row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import bounded_batches

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role of this initial leads to, by state; other steps are not in the grammar.
STEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: Length of the audits at which a common start is looked for.
UNSETTLED = 256

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, edit string, turn long, role string, text string"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32(`conv_id:turn`) % 20 (nulls: one space).

    0 drops the row (it stays as `gone`, without role and text, so that its conversation is still known), 1 empties the
    text, 2 removes its `.!?`, 3 repeats the row, 4 sets the role user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    gone = kind == 0
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    live = lambda c: F.when(~gone, c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), live(role).alias("role"), live(text).alias("text"), gone.alias("gone"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, first: sorted by conversation; first: role and text did not stand in an earlier turn."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    shown = lambda c: F.when(~gone, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), gone.alias("gone"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    said = F.concat_ws(":", conv, F.col("gone").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text"))
    place: Column = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumn("said", F.unhex(F.sha2(said, 256))).withColumn("place", place)
    earliest = rows.groupBy("said").agg(F.min("place").alias("earliest"))
    marked = rows.join(earliest, "said").select("conv_id", "turn", "role", "text", "gone", F.col("place").eqNullSafe(F.col("earliest")).alias("first"))
    return marked.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


class Conversation:
    """The automaton on one conversation's rows in order; `edits` gets (edit, turn, role, text) as they are settled."""

    def __init__(self, conv_id: int | None, edits: list | None = None):
        self.conv_id, self.edits = conv_id, edits
        self.best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self._close()
        self.settled: list[str] = []
        self.pending: deque = deque()
        self.limit, self.state, self.digest = UNSETTLED, START, hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.least, self.last_turn = 0, None, None
        self.initial, self.before = None, None

    def _close(self) -> None:
        """Bounded inserts: a user turn where one may follow, then an assistant turn."""
        best = self.best
        for at in (START, SYSTEM, ASSISTANT, USER):
            if best[at] is not None:
                cost, audit = best[at]
                offer, to = (cost + INSERT, audit + "I"), NEXT[at]
                if best[to] is None or offer < best[to]:
                    best[to] = offer

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        trimmed = text.rstrip(WHITE)
        again = not first or self.before == (turn, role, text)
        blank, cut = not trimmed, bool(trimmed) and trimmed[-1] not in ".!?"
        self.before = (turn, role, text)
        dead = blank or again
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not dead
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None:
            if self.turns == 0:
                self.least = turn
            self.turns += self.turns == 0 or turn != self.last_turn
            self.last_turn = turn
        self.pending.append((turn, role, text))
        more = TRUNCATED if cut else 0
        new: list[tuple[int, str] | None] = [None] * 4
        for at, here in enumerate(self.best):
            if here is None:
                continue
            cost, audit = here
            offers = [(at, (cost + DELETE, audit + "D"))]
            if not dead:
                kept = STEP.get((initial, at))
                if kept is not None:
                    offers.append((kept, (cost + KEEP + more, audit + "K")))
                offers.append((NEXT[at], (cost + REROLE + more, audit + "R")))
            for to, offer in offers:
                if new[to] is None or offer < new[to]:
                    new[to] = offer
        self.best = new
        self._close()
        # After an assistant turn all can follow that follows a system turn, and for one Delete more all that can start.
        cost = new[ASSISTANT][0]
        if new[SYSTEM] is not None and cost < new[SYSTEM][0]:
            new[SYSTEM] = None
        if new[START] is not None and cost + DELETE < new[START][0]:
            new[START] = None
        if len(new[ASSISTANT][1]) > self.limit:
            shared = commonprefix([b[1] for b in new if b is not None])
            self.best = [b and (b[0], b[1][len(shared) :]) for b in new]
            self._settle(shared)
            self.limit = max(UNSETTLED, 2 * len(self.best[ASSISTANT][1]))

    def _settle(self, letters: str) -> None:
        self.settled.append(letters)
        for letter in letters:
            turn, role, text = (None, "", "") if letter == "I" else self.pending.popleft()
            if letter != "D":
                to = STEP[role[:1], self.state] if letter == "K" else NEXT[self.state]
                role = role if letter == "K" else NAMES[to]
                self.digest.update((f"{role}:{text}" if self.state == START else f"\n{role}:{text}").encode())
                self.state = to
            if self.edits is not None:
                self.edits.append((self.conv_id, letter, turn, role, text))

    def finish(self) -> tuple:
        ends = [b for b in (self.best[START], self.best[ASSISTANT]) if b is not None]
        cost, rest = min(ends)
        self._settle(rest)
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled), self.digest.hexdigest())


def _stream(batches: Iterator[pa.RecordBatch], with_edits: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    now, out = None, []
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for conv_id, turn, role, text, gone, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    ended = now.finish()
                    if not with_edits:
                        out.append(ended)
                now = Conversation(conv_id, out if with_edits else None)
            if not gone:
                now.add(turn, role, text, first)
        if out:
            yield table(out)
            out.clear()
    if now is not None:
        ended = now.finish()
        if not with_edits:
            out.append(ended)
        if out:
            yield table(out)


def _run(rows: DataFrame, with_edits: bool, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(rows.sparkSession)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return _ordered(rows).mapInArrow(lambda batches: _stream(batches, with_edits, arrow), schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, edit, turn, role, text: the edits of each conversation in order. rows: conv_id, turn, role, text (, gone).

    edit is K, R, D or I. Without the rows of edit D these are the repaired conversations; inserted rows have no turn.
    """
    return _run(rows, True, EDITS)


def summarize(rows: DataFrame) -> DataFrame:
    """One row per conversation: SUMMARY, from the same automaton. audit: the edits' initials; repaired_sha256: lowercase hex of the
    repaired `role:text`, newline-joined; illegal: neighbours whose initials are none of su, ua, au."""
    return _run(rows, False, SUMMARY)
