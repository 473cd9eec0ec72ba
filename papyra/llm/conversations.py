"""Repair of conversations whose turns are missing, empty, repeated, cut or out of order.

A sound conversation has the roles ``(s?(ua)+)?``: an optional system turn, then
user and assistant in turn, ended by the assistant. Rows are kept, given another
role, deleted, or turns without text are inserted, at the least total cost. The
least cost and its edits are found by a recursive DuckDB query inside batches of
whole conversations that Spark has dealt out by a hash of their id: a recursion
advances all conversations of the batch by one turn and keeps, for every state of
the grammar, the least cost and its edits.

A conversation longer than ``SEGMENT_ROWS`` passes in segments. Each is solved
from every state that it can begin in, and the ends are joined; the repaired text
is hashed as it passes. So a task holds one batch, and of a longer conversation
one segment and its edits, one letter a row. One digest of a whole conversation
can only be taken in one task; Spark sorts its rows on disk.

Defined results: null texts and roles are one space, as are nulls in the key of
the damage; a role counts by its first character, so one that is empty or begins
with none of s, u, a is never kept; rows of one turn are ordered by role and text,
code point by code point; of equal rows the first is no duplicate; a null conv_id
is a conversation like others; one without rows after damage has zeros, no edits
and the digest of the empty string; an empty table gives an empty result; other
columns are ignored, whatever their names. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a batch and of a segment; a row counts once more for every ``ROW_CHARS`` of its text.
BATCH_ROWS = 8_000
SEGMENT_ROWS = 1_000
ROW_CHARS = 1_000

#: Costs of the edits; a row that is kept although it is cut costs as much again as a new role.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3

#: Grammar: state, the initial that leaves it, the state it leads to. 0 begins, 1 follows the system, 2 the user, 3 the assistant.
GRAMMAR = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]
ENDS = (0, 3)

#: Up to two inserted turns between rows lead everywhere; more come back to a state they were in.
_STEPS = f"""
WITH RECURSIVE grammar(state, initial, next) AS (VALUES {", ".join(f"({a}, '{x}', {b})" for a, x, b in GRAMMAR)}),
hops AS (
  SELECT s AS state, s AS next, '' AS edits, 0 AS cost FROM range(4) AS t(s)
  UNION ALL SELECT state, next, 'I', {INSERT} FROM grammar WHERE initial <> 's'
  UNION ALL SELECT a.state, b.next, 'II', {2 * INSERT} FROM grammar a JOIN grammar b ON a.next = b.state WHERE a.initial <> 's' AND b.initial <> 's'),
edits AS (
  SELECT state, initial, next, 'K' AS edit, 0 AS cost FROM grammar
  UNION ALL SELECT state, NULL, next, 'R', {REROLE} FROM grammar WHERE initial <> 's'
  UNION ALL SELECT s, NULL, s, 'D', {DELETE} FROM range(4) AS t(s)),
moves AS (
  SELECT h.state, e.initial, e.next, h.edits || e.edit AS edits, h.cost + e.cost AS cost, e.edit <> 'D' AS stays FROM hops h JOIN edits e ON h.next = e.state),
walk AS (
  SELECT job, origin, origin AS state, 0 AS place, 0::BIGINT AS cost, '' AS edits FROM starts
  UNION ALL
  SELECT job, origin, next, place, best.cost, best.edits FROM (
    SELECT w.job, w.origin, m.next, r.place, min({{'cost': w.cost + m.cost + CASE WHEN m.stays AND r.cut THEN {CUT} ELSE 0 END, 'edits': w.edits || m.edits}}) AS best
    FROM walk w JOIN turns r ON r.job = w.job AND r.place = w.place + 1 JOIN moves m ON m.state = w.state AND (m.initial IS NULL OR m.initial = r.initial)
    WHERE NOT (m.stays AND r.gone)
    GROUP BY w.job, w.origin, m.next, r.place))
SELECT job, origin, state, cost, edits FROM walk JOIN ends USING (job, place)"""

#: What is inserted after the last row, by the state it is reached in.
_CLOSING = {0: ("", 0), 1: ("II", 2 * INSERT), 2: ("I", INSERT), 3: ("", 0)}


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage by crc32(``conv_id:turn``) % 20; a row that is dropped has null ``copies``.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 gives it two ``copies``, 4 sets the role user.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    harm = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm <= 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(harm == 0, None).when(harm == 3, 2).otherwise(1).alias("copies"),
    )


def _solve(db, jobs: list[tuple[list, set[int]]]) -> dict[tuple[int, int], dict[int, tuple[int, str]]]:
    """Least cost and edits by job and state it begins in, then by the state it ends in.

    A job is a list of rows ``(initial, gone, cut)`` and the states it may begin in.
    """
    turns = [(j, i, *row) for j, (rows, _) in enumerate(jobs) for i, row in enumerate(rows, 1)]
    names = ["job", "place", "initial", "gone", "cut"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
    made = [pa.array(c, k) for c, k in zip(zip(*turns, strict=True), kinds, strict=True)] if turns else [pa.array([], k) for k in kinds]
    starts = [(j, s) for j, (_, states) in enumerate(jobs) for s in sorted(states)]
    db.register("turns", pa.table(made, names=names))
    db.register("starts", pa.table({"job": pa.array([j for j, _ in starts], pa.int32()), "origin": pa.array([s for _, s in starts], pa.int32())}))
    db.register("ends", pa.table({"job": pa.array(range(len(jobs)), pa.int32()), "place": pa.array([len(rows) for rows, _ in jobs], pa.int32())}))
    out: dict[tuple[int, int], dict[int, tuple[int, str]]] = {}
    for job, origin, state, cost, edits in db.execute(_STEPS).fetchall():
        out.setdefault((job, origin), {})[state] = (cost, edits)
    return out


class _Conversation:
    """What is known of a conversation so far; ``paths`` has cost, edits, turns and digest by state."""

    def __init__(self, key):
        self.key = key
        self.rows: list[tuple] = []
        self.paths = {0: (0, "", 0, hashlib.sha256())}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.low = self.high = None
        self.held = 0

    def add(self, turn, role: str, text: str, again: bool, copies: int) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        blank, whole = not text.strip(" \t\n\v\f\r"), text.rstrip(" \t\n\v\f\r").endswith((".", "!", "?"))
        for copy in range(copies):
            repeated = not blank and (again or copy > 0)
            cut = not (blank or repeated or whole)
            self.blank += blank
            self.duplicate += repeated
            self.truncated += cut
            if self.last is not None:
                self.illegal += self.last + role[:1] not in ("su", "ua", "au")
            self.last = role[:1]
            self.rows.append((role, text, blank or repeated, cut))
            self.held += 1 + len(text) // ROW_CHARS

    def advance(self, ends: dict[int, dict[int, tuple[int, str]]]) -> None:
        """Join the segment's results, by the state it begins in, to the paths so far and drop its rows."""
        best: dict[int, tuple[int, str, int, str]] = {}
        for origin, found in ends.items():
            cost, edits, _, _ = self.paths[origin]
            for state, (more, then) in found.items():
                path = (cost + more, edits + then, origin, then)
                if state not in best or path[:2] < best[state][:2]:
                    best[state] = path
        paths = {}
        for state, (cost, edits, origin, then) in best.items():
            _, _, turns, digest = self.paths[origin]
            digest, turns = self._repaired(origin, then, turns, digest.copy())
            paths[state] = (cost, edits, turns, digest)
        self.paths, self.rows, self.held = paths, [], 0

    def _repaired(self, state: int, edits: str, turns: int, digest):
        """The digest with the turns that the edits make of the segment's rows."""
        rows = iter(self.rows)
        for edit in edits:
            role, text = ("", "") if edit == "I" else next(rows)[:2]
            if edit == "D":
                continue
            system = edit == "K" and state == 0 and role[:1] == "s"
            state = 1 if system else 3 if state == 2 else 2
            if edit != "K":
                role = "assistant" if state == 3 else "user"
            digest.update((("\n" if turns else "") + f"{role}:{text}").encode())
            turns += 1
        return digest, turns

    def result(self) -> tuple:
        closed = []
        for state, (cost, edits, turns, digest) in self.paths.items():
            more, price = _CLOSING[state]
            closed.append((cost + price, edits + more, state, turns, digest))
        cost, edits, state, turns, digest = min(closed, key=lambda x: x[:2])
        self.rows = []
        digest, _ = self._repaired(state, _CLOSING[state][0], turns, digest.copy())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, edits, digest.hexdigest()


def _advance(db, some: list[_Conversation]) -> None:
    """Solve what the conversations hold."""
    some = [c for c in some if c.rows]
    if some:
        found = _solve(db, [([(role[:1], gone, cut) for role, _, gone, cut in c.rows], set(c.paths)) for c in some])
        for j, c in enumerate(some):
            c.advance({s: found[j, s] for s in c.paths if (j, s) in found})


def repair(rows: DataFrame, batch_rows: int = BATCH_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Faults, least cost, edits and digest of each conversation of ``conv_id, turn, role, text, copies``.

    ``copies`` is how often a row stands there, null for a conversation's row
    that is not there at all. ``gaps`` counts turns missing between the least and
    the greatest. A row's first fault counts: blank, duplicate (role and text
    stood earlier), truncated (the last character is no mark of an end).
    """
    # One shuffle, by conversation: the window and the order of rows need no other.
    dealt = rows.select("conv_id", "turn", "role", "text", "copies").repartition("conv_id")
    there = F.col("copies").isNotNull()
    earlier = F.row_number().over(Window.partitionBy("conv_id", there, "role", "text").orderBy("turn")) > 1
    marked = dealt.withColumn("again", earlier).sortWithinPartitions("conv_id", there, "turn", "role", "text", "again")
    schema = rows.select("conv_id").schema
    for name, kind in (("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")):
        schema.add(name, kind)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        done: list[_Conversation] = []
        at: _Conversation | None = None
        held = 0

        def emit() -> pa.RecordBatch:
            _advance(db, done)
            columns = zip(*[c.result() for c in done], strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)
            done.clear()
            return out

        for batch in batches:
            for key, turn, role, text, copies, again in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if at is None or key != at.key:
                    if at is not None:
                        done.append(at)
                        held += at.held
                        if held >= batch_rows or len(done) >= batch_rows:
                            yield emit()
                            held = 0
                    at = _Conversation(key)
                if copies is not None:
                    at.add(turn, role, text, again, copies)
                    if at.held >= segment_rows:
                        _advance(db, [at])
        if at is not None:
            done.append(at)
            yield emit()

    return marked.mapInArrow(run, schema)
