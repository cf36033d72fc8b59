"""Repair of conversation structure by depth-first branch-and-bound.

A repaired conversation is empty, or an optional system turn and user and
assistant turns in alternation.  Rows are kept, given another role, deleted, or
turns without text are inserted, each at a cost; the cheapest plan wins, of
equals the one whose edits' initials come first.

The search sees one code a row (role initial and fault), never the texts.  A
node is a place in the rows and the role that went before.  An explicit stack
is worked off depth first, the most promising edit on top:

* a lower bound of what is left: each row's cheapest edit, and more for
  disjoint neighbours whose roles cannot follow one another.  When a node's
  edits are all done with, its bound rises to the least of theirs;
* the incumbent, the best whole plan so far as (cost, audit): prefixes whose
  cost and bound exceed its cost are cut, and when the stack is empty it is
  proved best;
* the best (cost, audit) a node was reached with: a worse prefix to the same
  node is cut, as whatever follows suits the better one too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, read, staged, tasks

#: The costs of the contract's edits, and what a truncated row costs unless deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Roles before the next row: none yet, system, user, assistant; and what may follow each.
START, SYSTEM, USER, ASSISTANT = range(4)
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_END = 4
_LEGAL = {(START, SYSTEM), (START, USER), (START, _END), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER),
          (ASSISTANT, _END)}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _before(a: tuple | None, b: tuple | None) -> bool:
    """Whether audit ``a`` comes before ``b``: chains of (rest, letter, length) that may share their start."""
    left: list[str] = []
    right: list[str] = []
    while a is not b:
        la, lb = a[2] if a else 0, b[2] if b else 0
        if la >= lb:
            left.append(a[1])
            a = a[0]
        if lb >= la:
            right.append(b[1])
            b = b[0]
    return left[::-1] < right[::-1]


def _spelt(chain: tuple | None) -> str:
    out = []
    while chain:
        out.append(chain[1])
        chain = chain[0]
    return "".join(reversed(out))


class _Search:
    """The cheapest plan for rows given as (role initial, fault) with fault '-' none, 't' truncated, 'x' to be deleted."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = [(_INITIAL.get(r), f) for r, f in rows]
        n = len(self.rows)
        self.base, self.next = [0] * (n + 1), [n] * (n + 1)  # next: the first row from here on that may stay
        self.pairs = [0] * (n + 2)
        self.saved = [0] * (n + 1)  # what keeping one system turn from here on may save, before any other turn
        for i in range(n - 1, -1, -1):
            role, fault = self.rows[i]
            fits = role in (USER, ASSISTANT)
            if fault == "x":
                least = DELETE
            elif fault == "t":
                least = TRUNCATED if fits else min(REROLE + TRUNCATED, DELETE)
            else:
                least = 0 if fits else min(REROLE, DELETE)
            self.base[i] = self.base[i + 1] + least
            self.next[i] = self.next[i + 1] if fault == "x" else i
            self.saved[i] = self.saved[i + 1]
            if role == SYSTEM and fault != "x":
                self.saved[i] = max(self.saved[i], least - (TRUNCATED if fault == "t" else 0))
            if fault == "x":
                self.pairs[i] = self.pairs[i + 1]
            else:
                j = self.next[i + 1]
                self.pairs[i] = max(self.pairs[i + 1], self._clash(self._follows(i), i, j) + (
                    self.pairs[j + 1] if j < n else 0))
        self.learned: dict[tuple[int, int], int] = {}

    def _follows(self, i: int) -> int | None:
        """The role that row ``i`` has if it is kept; None for those that cannot stay as they are later on."""
        if i == len(self.rows):
            return _END
        return self.rows[i][0] if self.rows[i][0] != SYSTEM else None

    def _clash(self, role: int | None, i: int | None, j: int) -> int:
        """The least extra cost of two neighbours, row ``i`` (None: a role already settled) and row ``j``."""
        other = self._follows(j)
        if role is None or other is None or (role, other) in _LEGAL:
            return 0
        loose = any(k is not None and k < len(self.rows) and self.rows[k][1] == "t" for k in (i, j))
        return min(INSERT, REROLE, DELETE - TRUNCATED if loose else DELETE)

    def bound(self, i: int, role: int) -> int:
        known = self.learned.get((i, role))
        if known is None:
            j = self.next[i]
            known = self.base[i] - (self.saved[i] if role == START else 0) + max(
                self.pairs[i], self._clash(role, None, j) + (self.pairs[j + 1] if j < len(self.rows) else 0))
            self.learned[i, role] = known
        return known

    def edits(self, i: int, role: int) -> list[tuple[int, str, int, int]]:
        """(cost, initial, next place, role): what may be done here."""
        out = [(INSERT, "I", i, _TURN[role])]
        if i < len(self.rows):
            own, fault = self.rows[i]
            out.append((DELETE, "D", i + 1, role))
            if fault != "x":
                more = TRUNCATED if fault == "t" else 0
                if own and (role, own) in _LEGAL:
                    out.append((more, "K", i + 1, own))
                out.append((REROLE + more, "R", i + 1, _TURN[role]))
        return out

    def best(self) -> tuple[int, str]:
        cost, _ = self._descend(None)
        cost, audit = self._descend(cost)
        return cost, _spelt(audit)

    def _learn(self, i: int) -> None:
        """Raise the bounds of a place's nodes to the least of what may be done there, inserted turns first."""
        ahead = {role: min((c + self.bound(j, r) for c, letter, j, r in self.edits(i, role) if letter != "I"),
                           default=0 if (role, _END) in _LEGAL else DELETE * (len(self.rows) + 2))
                 for role in (START, SYSTEM, USER, ASSISTANT)}
        least = {USER: min(ahead[USER], INSERT + ahead[ASSISTANT]), ASSISTANT: min(ahead[ASSISTANT], INSERT + ahead[USER])}
        least |= {role: min(ahead[role], INSERT + least[USER]) for role in (START, SYSTEM)}
        for role, value in least.items():
            self.learned[i, role] = max(self.bound(i, role), value)

    def _descend(self, least_cost: int | None) -> tuple[int, tuple | None]:
        """Depth first: the least cost; or, that cost given, the first audit with it.

        Looking for the cost, prefixes that only equal the one a node was
        reached with are cut too.  The bounds learned lead the second descent.
        """
        n = len(self.rows)
        reached: dict[tuple[int, int], tuple[int, tuple | None]] = {}
        won: tuple[int, tuple | None] | None = None
        most = least_cost  # a plan may cost so much (None: anything)
        stack: list[tuple] = [(0, START, 0, None)]
        while stack:
            item = stack.pop()
            if len(item) == 1:  # all edits of a node are done with
                self._learn(*item)
                continue
            i, role, cost, audit = item
            if most is not None and cost + self.bound(i, role) > most:
                continue
            if least_cost is not None and won and cost + self.bound(i, role) == won[0] and _before(won[1], audit):
                continue
            have = reached.get((i, role))
            if have and (have[0] < cost or have[0] == cost and (least_cost is None or not _before(audit, have[1]))):
                continue
            reached[i, role] = (cost, audit)
            if i == n and (role, _END) in _LEGAL:
                if won is None or cost < won[0] or cost == won[0] and _before(audit, won[1]):
                    won = (cost, audit)
                    most = cost
                continue
            stack.append((i,))
            size = audit[2] + 1 if audit else 1
            todo = sorted(((c + self.bound(j, r), letter, c, j, r) for c, letter, j, r in self.edits(i, role)), reverse=True)
            stack += [(j, r, cost + c, (audit, letter, size)) for _, letter, c, j, r in todo]
        return won


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of the best plan for (role initial, fault) rows."""
    return _Search(rows).best()


def _order(id_col: str) -> list:
    return [F.col(id_col).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def _standard(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text, fault) of every row; a null role or text is one space."""
    named = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    solid = F.regexp_replace("text", SPACE, "")
    return named.withColumn("nth", nth).select(
        "id", "turn", "role", "text",
        F.when(solid == "", "b").when(F.col("nth") > 1, "d").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "t")
        .otherwise("-").alias("fault"))


def plans(rows: DataFrame) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) from (id, turn, role, text, fault) rows.

    Rows stream by in order; a conversation is held as one code a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            faults = [f for _, f in codes]
            illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(codes, codes[1:]))
            cost, audit = cheapest([(r, "x" if f in "bd" else f) for r, f in codes])
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            values = [gaps, *map(faults.count, "bdt"), illegal, cost]
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), *(pa.array([v], pa.int64()) for v in values), pa.array([audit])], names)

        now, codes, turns, kind = None, [], None, pa.null()  # turns: least, greatest, distinct
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if codes and i != now:
                    yield out()
                    codes, turns = [], None
                now = i
                codes.append((initial, fault))
                if turn is not None:
                    turns = (turns[0], turn, turns[2] + (turn != turns[1])) if turns else (turn, turn, 1)
        if codes:
            yield out()

    names = ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    id_kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition(tasks(rows.sparkSession), "id").sortWithinPartitions(*_order("id"))
    return dealt.select("id", "turn", F.substring("role", 1, 1), "fault").mapInArrow(
        run, f"id {id_kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(id, place, edit, role, text): the turns that the plans leave, in order, each conversation in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turn(letter: str, role: str | None, text: str) -> None:
            nonlocal last, place
            if letter == "K":
                last = _INITIAL[role[:1]]
            elif letter in "RI":
                last = _TURN[last]
                role = _NAMES[last]
            if letter != "D":
                out.append((now, place, letter, role, text))
                place += 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                turn("I", None, "")
                at += 1

        now, audit, at, last, place, kind = None, "", 0, START, 0, pa.null()
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for i, plan, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if plan is not None:  # a plan comes before its rows
                    inserts()
                    now, audit, at, last, place = i, plan, 0, START, 0
                else:
                    inserts()
                    turn(audit[at], role, text)
                    at += 1
            if out:
                yield _turns(out, kind)
        out = []
        inserts()
        if out:
            yield _turns(out, kind)

    def _turns(out: list[tuple], kind) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)],
                                          ["id", "place", "edit", "role", "text"])

    none = F.lit(None)
    both = made.select("id", F.lit(0).alias("kind"), "audit", none.cast("long").alias("turn"), F.lit("").alias("role"),
                       F.lit("").alias("text")).union(
        rows.select("id", F.lit(1), none.cast("string"), "turn", "role", "text"))
    order = _order("id")
    dealt = both.repartition(tasks(rows.sparkSession), "id").sortWithinPartitions(order[0], "kind", *order[1:])
    id_kind = rows.schema["id"].dataType.simpleString()
    return dealt.select("id", "audit", "role", "text").mapInArrow(
        run, f"id {id_kind}, place long, edit string, role string, text string")


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns) of the conversations in ``rows``.

    The report has a row for each conversation: (id_col, gaps, blank, duplicate,
    truncated, illegal, cost, audit); turns has the repaired ones: (id_col,
    place, edit, role, text).  Rows go by turn, nulls first, then by role and
    text.  A row's first fault counts: blank, the same role and text as an
    earlier row, or no closing mark.  Null roles and texts are one space, so
    such texts are blank; a role with another initial than s, u, a, or none, cannot be kept; rows of a null id are one conversation; null turns
    are no part of gaps.  Repeated rows are duplicates; an empty table gives
    empty results; other columns play no part.
    """
    flagged = staged(_standard(rows, id_col, turn_col, role_col, text_col), "flagged")
    made = staged(plans(flagged), "plans")
    return (made.withColumnRenamed("id", id_col),
            repaired(flagged, made).select(F.col("id").alias(id_col), "place", "edit", "role", "text"))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) damaged by the checksum of ``conv_id:turn``; nulls are one space."""
    def known(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(
        known("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.withColumn("kind", kind).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("copy")).drop("copy")


def _digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns that stand in order, each conversation in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, kind = None, None, pa.null()
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for i, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if have:
                        done.append((now, have.hexdigest()))
                    now, have = i, hashlib.sha256()
                have.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], kind), pa.array([h for _, h in done])], names)
        if have:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([have.hexdigest()])], names)

    names = ["conv_id", "repaired_sha256"]
    return turns.select("conv_id", "place", "role", "text").mapInArrow(
        run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults and cheapest repair of every conversation."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(rows)


def repair_report(rows: DataFrame) -> DataFrame:
    """The contract's row for every ``conv_id`` of ``rows``, which are damaged first."""
    report, turns = repair_conversations(damage(rows))
    every = rows.select(F.col("conv_id").alias("own")).distinct()
    sums = _digests(turns).toDF("conv", "sha")
    out = every.join(report, F.col("own").eqNullSafe(F.col("conv_id")), "left").join(
        sums, F.col("own").eqNullSafe(F.col("conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(F.col("own").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
