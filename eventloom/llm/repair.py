"""Repair of conversations: the cheapest edits that make the roles an optional system turn and pairs of user and assistant.

A scan of min-plus matrices. States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A turn is a 4 x 4 matrix whose
entry (i, j) is the least (cost, audit) of edits that lead from i to j over that turn, insertions before it included (the insert
closure). Products of matrices are associative, and keep the least audit among equal costs: paths between the same states over the
same turns that cost the same never have an audit that starts with the other's. So turns are dealt by ranges of (conversation,
turn), each task reduces its runs as a tree, and the matrices of a conversation that lies in many tasks meet in further levels of
64. Decisions go down the same levels. No task holds a conversation: at most a block of its turns, or 64 matrices; the one string
that grows with it is its audit, which is a result.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; turns come by (turn, role, text), null
turns first; rows that repeat all four columns are one row with a count and then turns of their own, all but the first being
duplicates; roles whose initial is not s, u or a can only be reroled or deleted; other columns are not used; of no turns, no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, lean, small_batches, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INITIALS, FAULTS = "sua", ("blank", "duplicate", "truncated")
#: State after a turn of role s, u, a in each state; None: not allowed.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ROLE = ("user", "user", "assistant", "user")  # what an inserted or reroled turn is in each state
NEXT = (2, 2, 3, 2)
BLOCK, FAN = 12, 6  # bits: turns of a block, matrices merged at once

Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]


def damaged(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with faults put in by the CRC-32 of "conv_id:turn" modulo 20: 0 drops a turn, 1 empties its
    text, 2 takes its [.!?], 3 repeats it, 4 makes it the user's. Nulls become one space first, also inside the key."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    plain = turns.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return plain.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


# ---------------------------------------------------------------- the algebra


def product(a: Matrix, b: Matrix) -> Matrix:
    out: list[Entry] = [None] * 16
    for i in range(0, 16, 4):
        for k in range(4):
            x = a[i + k]
            if x is None:
                continue
            cost, audit = x
            for j in range(4):
                y = b[4 * k + j]
                if y is not None:
                    z, now = cost + y[0], out[i + j]
                    if now is None or z < now[0] or z == now[0] and audit + y[1] < now[1]:
                        out[i + j] = (z, audit + y[1])
    return tuple(out)


def _unit() -> Matrix:
    return tuple((0, "") if i == j else None for i in range(4) for j in range(4))


@cache
def closure() -> Matrix:
    """Any number of insertions."""
    once = tuple(min((x for x in ((0, "") if i == j else None, (INSERT, "I") if NEXT[i] == j else None) if x), default=None) for i in range(4) for j in range(4))
    return product(once, product(once, once))  # three reach every state


@cache
def turn_matrix(initial: str, fault: str) -> Matrix:
    """Insertions, then one turn of this initial and first fault."""
    edits: list[Entry] = [None] * 16
    bound = fault in ("blank", "duplicate")
    for i in range(4):
        choices = [(DELETE, "D", i)]
        if not bound:
            extra = TRUNCATED if fault == "truncated" else 0
            choices.append((REROLE + extra, "R", NEXT[i]))
            to = AFTER[initial][i] if initial in AFTER else None
            if to is not None:
                choices.append((KEEP + extra, "K", to))
        for cost, letter, j in choices:
            now = edits[4 * i + j]
            edits[4 * i + j] = min((cost, letter), now) if now else (cost, letter)
    return product(closure(), tuple(edits))


def power(m: Matrix, n: int) -> Matrix:
    out = _unit()
    while n:
        if n & 1:
            out = product(out, m)
        m, n = product(m, m) if n > 1 else m, n >> 1
    return out


#: What a run of turns comes to: matrix, turns, first and last initial, illegal neighbours, faults, first, last and number of turn values.
Run = tuple[Matrix, int, str, str, int, int, int, int, int | None, int | None, int]


def one_run(turn: int | None, n: int, initial: str, fault: str) -> Run:
    """n equal turns: the first has `fault`, the others are duplicates, or blank as the first."""
    rest = "blank" if fault == "blank" else "duplicate"
    matrix = turn_matrix(initial, fault)
    if n > 1:
        matrix = product(matrix, power(turn_matrix(initial, rest), n - 1))
    faults = [int(f == fault) + (n - 1) * (f == rest) for f in FAULTS]
    return (matrix, n, initial, initial, n - 1, *faults, turn, turn, int(turn is not None))


def joined(a: Run, b: Run) -> Run:
    legal = a[3] + b[2] in ("su", "ua", "au")
    low, high = (a[8] if a[8] is not None else b[8]), (b[9] if b[9] is not None else a[9])
    return (product(a[0], b[0]), a[1] + b[1], a[2], b[3], a[4] + b[4] + (not legal), a[5] + b[5], a[6] + b[6], a[7] + b[7], low, high, a[10] + b[10] - (a[9] is not None and a[9] == b[8]))


class Tree:
    """Runs joined in order as a balanced tree."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Run]] = []

    def add(self, run: Run) -> None:
        size = 1
        while self.stack and self.stack[-1][0] == size:
            run = joined(self.stack.pop()[1], run)
            size *= 2
        self.stack.append((size, run))

    def total(self) -> Run:
        return reduce(lambda right, left: joined(left, right), reversed([r for _, r in self.stack]))


def cut(audit: str, start: int, runs: list[Run]) -> Iterator[tuple[int, str]]:
    """(state before, audit) of each run in turn, of their common audit; insertions at the end go with the last."""
    ends = [m.end() for m in re.finditer("[^I]", audit)]
    state, at, done = start, 0, 0
    for k, run in enumerate(runs):
        done += run[1]
        end = ends[done - 1]
        part = audit[at:end]
        yield state, part if k + 1 < len(runs) else audit[at:]
        state, at = next(j for j in range(4) if (x := run[0][4 * state + j]) is not None and x[1] == part), end


# ---------------------------------------------------------------- turns in order


def in_order(turns: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text, n, initial, fault, at): different turns in order of at, a number that is unique and
    rises within a conversation, though with gaps."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text")).withColumn("h", F.xxhash64("role", "text"))
    # only turns whose hash comes more than once in a conversation are compared by text
    many = base.groupBy("conv_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("h").alias("g"), F.lit(True).alias("many"))
    marked = base.join(many, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g")), "left")
    alone = marked.where("many IS NULL").select("conv_id", "turn", "role", "text", F.lit(1).cast("long").alias("n"), F.lit(True).alias("fresh"))
    equal = marked.where("many").groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    first = equal.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    again = equal.join(first, same).select("conv_id", "turn", "role", "text", "n", F.col("turn").eqNullSafe(F.col("first")).alias("fresh"))
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(end == "", "blank").when(~F.col("fresh"), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    rows = alone.unionByName(again).select("conv_id", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")


# ---------------------------------------------------------------- levels

_RUN = "costs array<long>, audits array<string>, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long, low long, high long, distinct long"


def _flat(run: Run) -> list:
    m = run[0]
    return [[x[0] if x else None for x in m], [x[1] if x else None for x in m], *run[1:]]


def _run(row: dict) -> Run:
    return (tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)), *(row[k] for k in ("turns", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "distinct")))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from batch.slice(at, 1024).to_pylist()


def _sent(rows: Iterable[list], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some thousands, or a few megabytes of their strings."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, have, size = to_arrow_schema(schema), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in have], f.type) for k, f in enumerate(arrow)], schema=arrow)

    for r in rows:
        have.append(r)
        size += sum(len(x) if isinstance(x, str) else sum(len(y or "") for y in x if not isinstance(y, int)) if isinstance(x, list) else 0 for x in r)
        if len(have) == 4096 or size > 4 << 20:
            yield batch()
            have, size = [], 0
    if have:
        yield batch()


def _schema(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([df.schema["conv_id"], *T.StructType.fromDDL(more).fields])


def _mapped(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    return df.mapInArrow(lean(lambda batches: _sent(run(_rows(batches)), schema)), schema)


def _together(rows: Iterator[dict], same) -> Iterator[list[dict]]:
    """Lists of neighbouring rows for which same(the one before, this) is true."""
    group: list[dict] = []
    for r in rows:
        if group and not same(group[-1], r):
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def runs(placed: DataFrame) -> DataFrame:
    """(conv_id, at, and a run) of neighbouring turns of a block, as each task reads them."""

    def reduce_turns(rows: Iterator[dict]) -> Iterator[list]:
        before, tree, key = None, Tree(), None
        for r in rows:
            if before is None or r["conv_id"] != before["conv_id"] or r["at"] != before["at"] + 1 or r["at"] >> BLOCK != before["at"] >> BLOCK:
                if before is not None:
                    yield [*key, *_flat(tree.total())]
                tree, key = Tree(), (r["conv_id"], r["at"])
            tree.add(one_run(r["turn"], r["n"], r["initial"], r["fault"]))
            before = r
        if before is not None:
            yield [*key, *_flat(tree.total())]

    narrow = placed.select("conv_id", "turn", "n", "initial", "fault", "at")
    return _mapped(narrow, reduce_turns, _schema(placed, f"at long, {_RUN}"))


def merged(level: DataFrame, shift: int) -> DataFrame:
    """Runs of the same conversation and the same at >> shift as one."""

    def merge(rows: Iterator[dict]) -> Iterator[list]:
        for group in _together(rows, lambda a, b: a["conv_id"] == b["conv_id"] and a["at"] >> shift == b["at"] >> shift):
            tree = Tree()
            for r in group:
                tree.add(_run(r))
            yield [group[0]["conv_id"], group[0]["at"], *_flat(tree.total())]

    dealt = level.repartition("conv_id", F.shiftright("at", shift)).sortWithinPartitions("conv_id", "at")
    return _mapped(dealt, merge, level.schema)


_DECISION = "at long, state int, audit string, before long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, whole string"


def _decided(group: list[dict], audit: str, state: int, before: int, summary: list) -> Iterator[list]:
    for r, (start, part) in zip(group, cut(audit, state, [_run(r) for r in group]), strict=True):
        yield [r["conv_id"], r["at"], start, part, before, *summary]
        before += len(part) - part.count("D")
        summary = [None] * len(summary)


def roots(level: DataFrame) -> DataFrame:
    """The decision on every conversation, cut to its runs: the state and the number of repaired turns before a run, and its
    audit. The first run's row has the conversation's faults, cost and whole audit."""

    def decide(rows: Iterator[dict]) -> Iterator[list]:
        for group in _together(rows, lambda a, b: a["conv_id"] == b["conv_id"]):
            tree = Tree()
            for r in group:
                tree.add(_run(r))
            run = tree.total()
            ends = product(run[0], closure())
            cost, audit = min(x for x in (ends[0], ends[3]) if x)
            gaps = 0 if run[8] is None else run[9] - run[8] + 1 - run[10]
            yield from _decided(group, audit, 0, 0, [gaps, *run[5:8], run[4], cost, audit])

    return _mapped(level.repartition("conv_id").sortWithinPartitions("conv_id", "at"), decide, _schema(level, _DECISION))


def _lower(level: DataFrame, decisions: DataFrame, shift: int) -> DataFrame:
    """Decisions on merged runs, cut to the runs of the level below."""
    names = [f.name for f in decisions.schema.fields]
    both = level.withColumn("kind", F.lit(1)).unionByName(decisions.withColumn("kind", F.lit(0)), allowMissingColumns=True)

    def lower(rows: Iterator[dict]) -> Iterator[list]:
        for group in _together(rows, lambda a, b: b["kind"] == 1):
            head = group[0]
            yield from _decided(group[1:], head["audit"], head["state"], head["before"], [head[n] for n in names[5:]])

    # a merged run and the first of its runs start at the same at
    dealt = both.repartition("conv_id", F.shiftright("at", shift)).sortWithinPartitions("conv_id", "at", "kind")
    return _mapped(dealt, lower, decisions.schema)


def decisions(placed: DataFrame) -> DataFrame:
    """A table of the decision on every run of runs(placed)."""
    small_batches(placed.sparkSession)
    levels, shift = [(written(runs(placed), "runs"), BLOCK)], BLOCK
    while (most := levels[-1][0].groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]) and most > 1 << FAN and shift < 63:
        shift = min(63, shift + FAN)
        levels.append((written(merged(levels[-1][0], shift), "runs"), shift))
    out = written(roots(levels[-1][0]), "decisions")
    for (level, _), (upper, above) in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        lower = written(_lower(level, out, above), "decisions")
        forget(out), forget(upper)
        out = lower
    forget(levels[0][0])
    return out


# ---------------------------------------------------------------- edits applied

_TURNS = "position long, edit string, turn long, role string, text string"


def _edited(audit: str, state: int, turns: Iterator[dict]) -> Iterator[tuple[str, dict | None, str, str]]:
    """(edit, turn if any, role, text) of each repaired turn of a run. Roles before an insertion follow from the state."""
    turn, left = None, 0
    for letter in audit:
        if letter == "I":
            yield letter, None, ROLE[state], ""
            state = NEXT[state]
            continue
        if not left:
            turn = next(turns)
            left = turn["n"]
        left -= 1
        if letter == "R":
            yield letter, turn, ROLE[state], turn["text"]
            state = NEXT[state]
        elif letter == "K":
            yield letter, turn, turn["role"], turn["text"]
            state = AFTER[turn["role"][:1]][state]


def _with_turns(decided: DataFrame, placed: DataFrame) -> DataFrame:
    rows = placed.select("conv_id", "at", F.lit(2).alias("kind"), "n", "turn", "role", "text")
    return decided.withColumn("kind", F.lit(1)).unionByName(rows, allowMissingColumns=True)


def _of_run(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[dict]]]:
    """(decision, its turns) from rows in order; the turns must be read before the next decision."""
    head = next(rows, None)
    while head is not None:
        after: list[dict] = []

        def turns(after=after) -> Iterator[dict]:
            for r in rows:
                if r["kind"] != 2:
                    after.append(r)
                    return
                yield r

        own = turns()
        yield head, own
        for _ in own:  # none are left, unless the caller stopped early
            pass
        head = after[0] if after else None


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the repaired turns of every conversation; edit is K (kept), R (role set) or I
    (inserted, empty, turn null). Dealt by blocks of a conversation's turns."""
    placed = in_order(turns)
    both = _with_turns(decisions(placed), placed)

    def apply(rows: Iterator[dict]) -> Iterator[list]:
        for head, own in _of_run(rows):
            for k, (edit, turn, role, text) in enumerate(_edited(head["audit"], head["state"], own)):
                yield [head["conv_id"], head["before"] + k, edit, turn and turn["turn"], role, text]

    dealt = both.repartition("conv_id", F.shiftright("at", BLOCK)).sortWithinPartitions("conv_id", "at", "kind")
    return _mapped(dealt, apply, _schema(placed, _TURNS))


def report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of conversations.

    The digest is of the repaired conversation as lines role:text. A digest has to see its text in one place and in order: its task
    streams the turns through the hash and holds a batch of them at a time.
    """
    placed = in_order(turns)
    decided = decisions(placed)
    every = conversations.select("conv_id").distinct().withColumn("kind", F.lit(0))
    both = _with_turns(decided, placed).unionByName(every, allowMissingColumns=True)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "whole")

    def digest(rows: Iterator[dict]) -> Iterator[list]:
        now, sha, values, begun = None, hashlib.sha256(), None, False
        for head, own in _of_run(rows):
            if head["kind"] == 0 or values is None or head["conv_id"] != now:
                if values is not None:
                    yield [now, *values, sha.hexdigest()]
                now, sha, values, begun = head["conv_id"], hashlib.sha256(), [0] * 6 + [""], False
            if head["kind"] == 0:
                continue
            if head["whole"] is not None:
                values = [head[n] for n in names]
            for _, _, role, text in _edited(head["audit"], head["state"], own):
                sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
        if values is not None:
            yield [now, *values, sha.hexdigest()]

    schema = _schema(placed, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return _mapped(both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind"), digest, schema)
