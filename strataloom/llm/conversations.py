"""Operator 11, conversation structure repair: weighted finite-state composition.

Three machines: an acceptor of a conversation's turns in order, a transducer whose arcs are the edits (keep, give
another role, delete, insert) with their costs, and an acceptor of the role initials that a well-formed conversation has.
They are composed lazily: a state of the composition is made when a path reaches it. Weights are pairs of a cost and a
label string, ordered lexicographically; paths add both, and the least pair survives in each state. The transducer counts
the insertions since the last turn, so the composition has no cycle and the states are met in topological order.

Turns stream through in order. As soon as all surviving paths agree on a beginning, its edits are final and leave.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import shared

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of a truncated turn that stays.
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: Roles that an edit may give.
GIVEN = ("user", "assistant")
#: Acceptor of ``(s?(ua)+)?`` over role initials: arcs by state, and the final states. 0 is the start.
GRAMMAR: dict[int, dict[str, int]] = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = frozenset({0, 3})
#: Insertions in a row, at most: one more would come back to a state of the grammar at a higher cost.
MOST_INSERTS = 2
#: From any state, what another one could still accept is reached by two insertions and the deletion of a first system
#: turn at most. A path that costs more than this above the least one is never the best.
BRIDGE = 2 * COSTS[INSERT] + COSTS[DELETE]
#: Undecided turns before the paths are asked again what they agree on.
UNDECIDED = 64

_ACTIONS = "conv_id long, step long, turn long, edit string, fault string, role_before string, role string, text string, cost long"
_SPACE = " \t\n\x0b\x0c\r"


class Turn(NamedTuple):
    initial: str
    must_go: bool
    truncated: bool


class Arc(NamedTuple):
    label: str
    cost: int
    out: str | None  # the initial that the grammar reads; None for none


def edits_of(turn: Turn) -> Iterator[Arc]:
    """Arcs of the edit transducer that read this turn."""
    yield Arc(DELETE, COSTS[DELETE], None)
    if not turn.must_go:
        more = TRUNCATED_COST if turn.truncated else 0
        yield Arc(KEEP, COSTS[KEEP] + more, turn.initial)
        for role in GIVEN:
            yield Arc(REROLE, COSTS[REROLE] + more, role[0])


class Composition:
    """Surviving paths over the turns read so far: (cost, labels) by state of the grammar."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, str]] = {0: (0, "")}

    def _with_inserts(self) -> dict[int, tuple[int, str]]:
        """By insertion count, which orders the states; of a grammar state the least weight counts, whatever the count."""
        layer, out = self.best, dict(self.best)
        for _ in range(MOST_INSERTS):
            after: dict[int, tuple[int, str]] = {}
            for state, (cost, labels) in layer.items():
                for role in GIVEN:
                    to = GRAMMAR[state].get(role[0])
                    if to is not None:
                        w = (cost + COSTS[INSERT], labels + INSERT)
                        after[to] = min(after.get(to, w), w)
            layer = after
            for to, w in after.items():
                out[to] = min(out.get(to, w), w)
        return out

    def read(self, turn: Turn) -> None:
        after: dict[int, tuple[int, str]] = {}
        for state, (cost, labels) in self._with_inserts().items():
            for arc in edits_of(turn):
                to = state if arc.out is None else GRAMMAR[state].get(arc.out)
                if to is not None:
                    w = (cost + arc.cost, labels + arc.label)
                    after[to] = min(after.get(to, w), w)
        most = min(after.values())[0] + BRIDGE
        self.best = {state: w for state, w in after.items() if w[0] <= most}

    def settled(self) -> str:
        """The labels that all paths begin with; they are cut off the paths."""
        same = os.path.commonprefix([labels for _, labels in self.best.values()])
        self.best = {state: (cost, labels[len(same) :]) for state, (cost, labels) in self.best.items()}
        return same

    def end(self) -> str:
        """The rest of the least path to a final state. Deleting everything is one, so there always is one."""
        return min(w for state, w in self._with_inserts().items() if state in FINAL)[1]


class Walk:
    """Applies labels to the turns that wait, and tells which grammar state, hence which role, each edit leads to."""

    def __init__(self) -> None:
        self.state = 0

    def role_of(self, label: str, role: str) -> str | None:
        if label == DELETE:
            return None
        to = role if label == KEEP else next(r for r in GIVEN if r[0] in GRAMMAR[self.state])
        self.state = GRAMMAR[self.state][to[:1]]
        return to


def repair(turns: DataFrame) -> DataFrame:
    """The edits, in order, that make each conversation well-formed at the least cost, with what they make.

    One row an edit: ``edit`` (K, R, D or I), ``fault`` of the turn (blank, duplicate, truncated or null; its first one),
    ``role_before`` and ``turn`` (null for insertions), ``role`` and ``text`` after it (``role`` null where deleted),
    ``cost``. Of all cheapest repairs the one whose labels come first is taken. Rows with an edit other than D, in the
    order of ``step``, are the repaired conversation. Inside a partition rows are ordered by conversation and step.

    turns needs ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored. Null roles and texts are one
    blank. Turns come in ascending order, null first, ties by role and text. Rows without a conv_id are one conversation.
    A turn whose role is neither system, user nor assistant can't stay as it is. An empty table gives no rows.
    A conversation's turns meet in one task, by contract, which holds those not decided yet and 16 bytes for each turn.
    """
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumns({"blank": bare == "", "truncated": ~F.right(bare, F.lit(1)).isin(".", "!", "?")})
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    names = [x.split()[0] for x in _ACTIONS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in _ACTIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conversation: object = run  # none yet
        paths, walk, waiting, seen, step = Composition(), Walk(), deque(), set(), 0

        def apply(labels: str) -> None:
            nonlocal step
            for label in labels:
                if label == INSERT:
                    out.append((conversation, step, None, label, None, None, walk.role_of(label, ""), "", COSTS[INSERT]))
                else:
                    turn, role, text, fault = waiting.popleft()
                    cost = COSTS[label] + (TRUNCATED_COST if fault == "truncated" and label != DELETE else 0)
                    out.append((conversation, step, turn, label, fault, role, walk.role_of(label, role), text, cost))
                step += 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
            out.clear()
            return made

        for batch in batches:
            for piece in shared.slices(batch):
                for conv, turn, role, text, blank, truncated in zip(*[piece.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "truncated")], strict=True):
                    if conv != conversation:
                        if conversation is not run:
                            apply(paths.end())
                        conversation, paths, walk, seen, step = conv, Composition(), Walk(), set(), 0
                    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                    fault = "blank" if blank else "duplicate" if key in seen else "truncated" if truncated else None
                    seen.add(key)
                    paths.read(Turn(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
                    waiting.append((turn, role, text, fault))
                    if len(waiting) % UNDECIDED == 0:
                        apply(paths.settled())
                if out:
                    yield batch_of()
        if conversation is not run:
            apply(paths.end())
            yield batch_of()

    return ordered.mapInArrow(run, _ACTIONS)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by the CRC-32 of conversation and turn modulo 20: 0 drops a row, 1 empties its text,
    2 removes its full stops, exclamation and question marks, 3 repeats it, 4 gives it the role user. Nulls of role and
    text become one blank, and count as one in the number."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = frozenset({"su", "ua", "au"})


def audited(actions: DataFrame) -> DataFrame:
    """One row a conversation: counts of faults, cost, labels, and the SHA-256 of the repaired ``role:text`` lines.

    ``actions`` must come straight from ``repair``, whose order inside partitions this reads."""
    names = [x.split()[0] for x in _AUDIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation: object = run

        def total() -> tuple:
            gaps = turns[-1] - turns[0] + 1 - turns[1] if turns else 0
            return (conversation, gaps, *(faults.get(f, 0) for f in ("blank", "duplicate", "truncated")), illegal, cost, "".join(labels), sha.hexdigest())

        for batch in batches:
            done = []
            for conv, turn, label, fault, before, role, text, c in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "turn", "edit", "fault", "role_before", "role", "text", "cost")], strict=True):
                if conv != conversation:
                    if conversation is not run:
                        done.append(total())
                    conversation, turns, faults, illegal, cost, labels, sha, last, first = conv, None, {}, 0, 0, [], hashlib.sha256(), None, True
                cost += c
                labels.append(label)
                if label != INSERT:
                    if fault:
                        faults[fault] = faults.get(fault, 0) + 1
                    illegal += last is not None and last + before[:1] not in _LEGAL
                    last = before[:1]
                    if turn is not None and (turns is None or turns[-1] != turn):  # least, distinct, greatest
                        turns = (turns[0], turns[1] + 1, turn) if turns else (turn, 1, turn)
                if role is not None:
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string() if k > 6 else pa.int64()) for k, x in enumerate(zip(*done, strict=True))], names)
        if conversation is not run:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if k > 6 else pa.int64()) for k, x in enumerate(total())], names)

    return actions.mapInArrow(run, _AUDIT)


def audit(turns: DataFrame) -> DataFrame:
    """Damages all conversations, repairs them and tells for every original one what was wrong and what it took.

    A conversation that the damage leaves without rows has zeros, no labels, and the hash of an empty text.
    """
    found = audited(repair(damaged(turns)))
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    columns = [F.coalesce(found[x.split()[0]], F.lit(none.get(x.split()[0], 0)).cast(x.split()[1])).alias(x.split()[0]) for x in _AUDIT.split(", ")[1:]]
    return every.join(found, every.conv_id.eqNullSafe(found.conv_id), "left").select(every.conv_id, *columns)


#: A single row with ``t``, the table of CRC-32 by byte, made by its rule.
CRC_SQL = """
crc_steps(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc(t) AS (SELECT list(c ORDER BY i) FROM crc_steps WHERE k = 8)"""


def crc_sql(codes: str) -> str:
    """SQL for the CRC-32 of a list of byte values, with the row of CRC_SQL in scope."""
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def oracle_sql() -> str:
    """The same as a recursion over turns whose state is, for each state of the grammar, the least (cost, labels, lines)."""
    far = 1_000_000_000
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def least(*arcs: tuple) -> str:
        """The least weight over arcs of (weight before, cost, label, line)."""
        rows = ", ".join(f"{{'w': {w}, 'd': ({cost})::BIGINT, 'l': '{label}', 't': {line}}}" for w, cost, label, line in arcs)
        return f"list_min(list_transform([{rows}], lambda x: {{'c': x.w.c + x.d, 'a': x.w.a || x.l, 'r': x.w.r || x.t}}))"

    stay, more = "NOT must_go", "(CASE WHEN truncated THEN 3 ELSE 0 END)"
    kept = lambda w, initial: (w, f"CASE WHEN {stay} AND initial = '{initial}' THEN {more} ELSE {far} END", "K", "chr(10) || role || ':' || text")
    given = lambda w, line: (w, f"CASE WHEN {stay} THEN 3 + {more} ELSE {far} END", "R", f"{line} || text")
    gone = lambda w: (w, "4", "D", "''")
    same = lambda w: (w, "0", "", "''")
    inserted = f"""SELECT *, {least(same("w3"), ("v2", "3", "I", assistant))} AS v3
        FROM (SELECT *, {least(same("w2"), *((w, "3", "I", user) for w in ("w0", "w1", "w3")))} AS v2 FROM %s)"""
    start, none = "{'c': 0::BIGINT, 'a': '', 'r': ''}", f"{{'c': {far}::BIGINT, 'a': '', 'r': ''}}"
    step = f"""SELECT conv_id, i + 1, {least(gone("w0"))} AS w0, {least(gone("w1"), kept("w0", "s"))} AS w1,
        {least(gone("v2"), *(x for w in ("w0", "w1", "v3") for x in (kept(w, "u"), given(w, user))))} AS w2,
        {least(gone("v3"), kept("v2", "a"), given("v2", assistant))} AS w3"""
    return rf"""
WITH RECURSIVE {CRC_SQL},
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {crc_sql("list_transform(string_split(key, ''), lambda x: unicode(x)::BIGINT)")} % 20 AS kind FROM plain, crc),
broken AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM broken),
faulty AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twice,
    right(bare, 1) NOT IN ('.', '!', '?') AS open, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM placed),
turns AS (SELECT *, blank OR twice AS must_go, open AND NOT blank AND NOT twice AS truncated FROM faulty),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS i, {start} AS w0, {none} AS w1, {none} AS w2, {none} AS w3 FROM counts
  UNION ALL {step} FROM ({inserted % "walk"}) JOIN (SELECT conv_id AS conv, i AS place, initial, role, text, must_go, truncated FROM turns)
    ON conv IS NOT DISTINCT FROM conv_id AND place = i + 1),
ends AS (SELECT conv_id, n, {least(same("w0"), same("v3"))} AS w FROM ({inserted % "(SELECT walk.*, n FROM walk JOIN counts ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id AND i = n)"}))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit,
  sha256(coalesce(substr(w.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv_id
  LEFT JOIN ends ON o.conv_id IS NOT DISTINCT FROM ends.conv_id"""
