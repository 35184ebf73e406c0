"""Repair of conversation structure by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn, and a task reads them as one stream. Its state is a shortest-path
problem over four states (nothing yet, after the system turn, after a user turn, after an assistant turn): a row is
kept, given another role or deleted, and turns without text are inserted, so that the roles read ``(s?(ua)+)?``. Costs
relative to the cheapest state are bounded, so the state of the program is one of a few tuples and a step is looked up
after the first time. A row's backpointer is the number of its step (4 bytes). Once the paths of all live states meet in
one row, what lies before it is settled: edits and texts are given out and forgotten. What isn't settled yet waits
in a scratch file of the task beyond ``SPILL`` bytes (read by this task only and gone with it; a lost executor's
task starts anew), so a conversation of any length needs no memory but for its own audit, a byte a row.

Edits of equal cost: the ASCII-least audit wins. Two paths into one state that have read the same rows differ before one
of them ends, so their order is known by ranks of the paths and the letters added.

Defined results: rows of equal turns go by role and text; null turns come first; a null role or text is one space; a null
conversation is a conversation; repeated rows are duplicates; roles count by their first character; a conversation of
which no row is left has zeros, an empty audit and the hash of the empty text; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows that wait before the paths are looked at, and bytes that wait in memory.
SETTLE, SPILL = 4096, 1 << 22
WHITE = " \t\n\x0b\f\r"

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of role s, u or a.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Letters, cost and state of the turns that may be inserted; more of them would lead back to where they began.
INSERTED = (
    (("", 0, EMPTY), ("I", INSERT, USER), ("II", 2 * INSERT, ASSISTANT)),
    (("", 0, SYSTEM), ("I", INSERT, USER), ("II", 2 * INSERT, ASSISTANT)),
    (("", 0, USER), ("I", INSERT, ASSISTANT)),
    (("", 0, ASSISTANT), ("I", INSERT, USER)),
)
#: Any state does what any other can, after two insertions and a deletion at most; a path dearer by more is never the cheapest.
HOPELESS = 2 * INSERT + DELETE
#: Kinds of rows: one that must go, or the first character of the role (x: none of s, u, a) and whether the text is cut off.
KINDS = (None, *((c, cut) for c in "xsua" for cut in (False, True)))


class _Steps:
    """Steps from one tuple of (cost, rank) by state to the next, worked out once each."""

    def __init__(self):
        self.known: dict[tuple, tuple[int, int, tuple]] = {}
        self.moves: list[tuple] = []

    def __call__(self, now: tuple, kind: int) -> tuple[int, int, tuple]:
        """Number of the step, what all costs rise by, and the tuple after it."""
        found = self.known.get((now, kind))
        return found if found else self._worked_out(now, kind)

    def _worked_out(self, now: tuple, kind: int) -> tuple[int, int, tuple]:
        best: list[tuple | None] = [None] * 4
        for state, at in enumerate(now):
            if at is None:
                continue
            cost, rank = at
            for letters, price, before in INSERTED[state]:
                options = [("D", DELETE, before)]
                if KINDS[kind]:
                    role, cut = KINDS[kind]
                    extra = TRUNCATED if cut else 0
                    if role in NEXT[before]:
                        options.append(("K", extra, NEXT[before][role]))
                    options += [("R", REROLE + extra, to) for c, to in NEXT[before].items() if c != "s"]
                for letter, more, to in options:
                    way = (cost + price + more, rank, letters + letter, state)
                    if best[to] is None or way < best[to]:
                        best[to] = way
        least = min(b[0] for b in best if b)
        best = [b if b and b[0] - least <= HOPELESS else None for b in best]
        order = sorted({b[1:3] for b in best if b})
        self.moves.append(tuple((b[3], b[2]) if b else None for b in best))
        found = len(self.moves) - 1, least, tuple((b[0] - least, order.index(b[1:3])) if b else None for b in best)
        self.known[now, kind] = found
        return found


START = ((0, 0), None, None, None)
_LENGTHS = struct.Struct("<II")


class _Path:
    """The unsettled end of a conversation's edits: backpointers and texts, in memory or in scratch files."""

    def __init__(self, steps: _Steps, settle: int = SETTLE, spill: int = SPILL):
        self.steps, self.settle, self.spill = steps, settle, spill
        self.moves, self.lines = self._scratch(), self._scratch()
        self.reset()

    def _scratch(self):
        return tempfile.SpooledTemporaryFile(max_size=self.spill)

    def reset(self) -> None:
        self.now, self.cost, self.at, self.rows, self.next = START, 0, EMPTY, 0, self.settle
        self._clear()

    def _clear(self) -> None:
        for name in ("moves", "lines"):
            f = getattr(self, name)
            if f._rolled:
                f.close()
                setattr(self, name, self._scratch())
            else:
                f.seek(0), f.truncate()

    def add(self, kind: int, role: bytes, text: bytes) -> None:
        step, rise, self.now = self.steps(self.now, kind)
        self.cost += rise
        self.moves.write(step.to_bytes(4, "little"))
        self.lines.write(_LENGTHS.pack(len(role), len(text)) + role + text)
        self.rows += 1

    def settled(self) -> Iterator[tuple[str, bytes, bytes]]:
        """(edit, role, text) of what all live paths share, if enough rows wait to look."""
        if self.rows < self.next:
            return
        live = {s for s, at in enumerate(self.now) if at}
        yield from self._given(live, "")
        self.next = 2 * self.rows + self.settle

    def end(self) -> Iterator[tuple[str, bytes, bytes]]:
        """(edit, role, text) of the rest of the cheapest path; ``cost`` is then the whole cost."""
        ends = []
        for state, letters in ((EMPTY, ""), (SYSTEM, "II"), (USER, "I"), (ASSISTANT, "")):
            if self.now[state]:
                ends.append((self.now[state][0] + INSERT * len(letters), self.now[state][1], letters, state))
        more, _, letters, state = min(ends)
        self.cost += more
        yield from self._given({state}, letters)

    def _given(self, live: set[int], after: str) -> Iterator[tuple[str, bytes, bytes]]:
        letters: list[str] = []
        done = self.rows
        self.moves.seek(0)
        for block in range(self.rows // self.settle, -1, -1):
            self.moves.seek(4 * block * self.settle)
            steps = array("I", self.moves.read(4 * self.settle))
            for step in reversed(steps):
                moves = self.steps.moves[step]
                if len(live) > 1:
                    done -= 1
                    live = {moves[s][0] for s in live}
                else:
                    (s,) = live
                    letters.append(moves[s][1])
                    live = {moves[s][0]}
        # ``done`` rows have one path now; ``letters`` holds theirs from the last to the first.
        self.lines.seek(0)
        while letters:
            role_n, text_n = _LENGTHS.unpack(self.lines.read(_LENGTHS.size))
            role, text = self.lines.read(role_n), self.lines.read(text_n)
            yield from self._edited(letters.pop(), role, text)
        yield from self._edited(after, b"", b"")
        rest, left = self.lines.read() if done < self.rows else b"", self.rows - done
        self.moves.seek(4 * done)
        waiting = self.moves.read() if left else b""
        self._clear()
        self.moves.write(waiting), self.lines.write(rest)
        self.rows = left

    def _edited(self, letters: str, role: bytes, text: bytes) -> Iterator[tuple[str, bytes, bytes]]:
        for letter in letters:
            if letter == "D":
                yield "D", role, text
                continue
            if letter == "K":
                self.at = NEXT[self.at][role[:1].decode()]
            else:
                role, self.at = (b"assistant", ASSISTANT) if self.at == USER else (b"user", USER)
            yield letter, role, b"" if letter == "I" else text


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` of the rows after the damage that the crc32 of ``conv_id:turn`` draws; a dropped row stays, without role and text and marked as gone, so that its conversation is still known."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("d"))
    rows = rows.select("conv_id", "turn", "role", "text", "d", F.explode(F.expr("sequence(0, int(d = 3))")).alias("copy"))
    new_text = F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("d") == 0, "").when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), (F.col("d") == 0).alias("gone"))


BLANK, DUPLICATE, CUT = 1, 2, 3


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn, with the first fault and the kind of each; null ids and turns are told by flags, as longs have no null in pandas."""
    rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    first = F.left("role", F.lit(1))
    key = ["no_conv", "conv"]
    rows = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone",
    ).repartition(*key)
    again = F.row_number().over(Window.partitionBy(*key, "gone", "role", "text").orderBy(F.desc("no_turn"), "turn")) > 1
    fault = F.when(last == "", BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    role = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    rows = rows.withColumn("fault", fault).withColumn("initial", role)
    kind: Column = F.when(F.col("fault").isin(BLANK, DUPLICATE), 0).otherwise(1 + 2 * F.col("initial") + (F.col("fault") == CUT).cast("int"))
    return rows.withColumn("kind", kind).sortWithinPartitions(*key, F.desc("no_turn"), "turn", "role", "text")


_COLUMNS = ("no_conv", "conv", "gone", "no_turn", "turn", "role", "text", "fault", "initial", "kind")
_LEGAL = {(1, 2), (2, 3), (3, 2)}


class _Tally:
    """Faults, gaps and illegal neighbours of a conversation's rows."""

    def __init__(self):
        self.faults, self.illegal, self.before = [0] * 4, 0, None
        self.least = self.most = self.turn = None
        self.turns = 0

    def add(self, no_turn: bool, turn: int, fault: int, initial: int) -> None:
        self.faults[fault] += 1
        if self.before is not None and (self.before, initial) not in _LEGAL:
            self.illegal += 1
        self.before = initial
        if not no_turn:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.turn or self.most is None
            self.turn = self.most = turn

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def _conversations(batches: Iterator[pd.DataFrame], settle: int, spill: int) -> Iterator[tuple]:
    """("edit", conversation, letter, role, text) as edits are settled, and ("end", conversation, tally, cost) after each conversation."""
    steps = _Steps()
    path, key, tally = _Path(steps, settle, spill), None, _Tally()
    for batch in batches:
        for no_conv, conv, gone, no_turn, turn, role, text, fault, initial, kind in zip(*(batch[c].tolist() for c in _COLUMNS), strict=True):
            if key != (no_conv, conv):
                if key is not None:
                    yield from (("edit", key, *e) for e in path.end())
                    yield "end", key, tally, path.cost
                key, tally = (no_conv, conv), _Tally()
                path.reset()
            if gone:
                continue
            tally.add(no_turn, turn, fault, initial)
            path.add(kind, role.encode(), text.encode())
            if path.rows >= path.next:
                yield from (("edit", key, *e) for e in path.settled())
    if key is not None:
        yield from (("edit", key, *e) for e in path.end())
        yield "end", key, tally, path.cost


_AUDIT = "no_conv boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "no_conv boolean, conv long, place long, edit string, role string, text string"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _conv_id() -> Column:
    return F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id")


def audits(rows: DataFrame, settle: int = SETTLE, spill: int = SPILL) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text) rows: faults, gaps, illegal neighbours, the cost and letters of the cheapest edits, and the SHA-256 of the repaired ``role:text`` lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        audit, lines, digest = bytearray(), 0, hashlib.sha256()
        for what, key, *rest in _conversations(batches, settle, spill):
            if what == "edit":
                letter, role, text = rest
                audit += letter.encode()
                if letter != "D":
                    digest.update((b"\n" if lines else b"") + role + b":" + text)
                    lines += 1
                continue
            tally, cost = rest
            out.append((*key, tally.gaps(), tally.faults[BLANK], tally.faults[DUPLICATE], tally.faults[CUT], tally.illegal, cost, audit.decode(), digest.hexdigest()))
            audit, lines, digest = bytearray(), 0, hashlib.sha256()
            if len(out) >= 4096:
                yield _frame(out, _AUDIT)
                out = []
        yield _frame(out, _AUDIT)

    return _sorted(rows).select(*_COLUMNS).mapInPandas(run, _AUDIT).select(_conv_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame, settle: int = SETTLE, spill: int = SPILL) -> DataFrame:
    """The repaired turns: conv_id, place from 0, edit (K, R or I), role and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        place = size = 0
        for what, key, *rest in _conversations(batches, settle, spill):
            if what == "end":
                place = 0
            elif rest[0] != "D":
                out.append((*key, place, rest[0], rest[1].decode(), rest[2].decode()))
                place, size = place + 1, size + len(rest[2])
                if len(out) >= 4096 or size > SPILL:
                    yield _frame(out, _TURNS)
                    out, size = [], 0
        yield _frame(out, _TURNS)

    return _sorted(rows).select(*_COLUMNS).mapInPandas(run, _TURNS).select(_conv_id(), "place", "edit", "role", "text")
