"""Repair of the structure of conversations by lightest derivations, with Knuth's agenda.

A conversation should be nothing, or an optional system turn and then pairs of user and assistant. Items are (rows read, state);
edits of a row are axioms. A deduction joins an item and an edit of its next row, or an inserted turn, to the next item, and weighs
(cost, audit): costs add up, audits are strung together. Such functions are superior, as a derivation never weighs less than its
parts, and monotone, as two derivations of one item with equal cost part where both go on. So an item is final when the
agenda gives it first, and the search stops with the goal. Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an
empty turn of user or assistant 2; a truncated row that stays adds 1; blank and duplicate rows must go. Equal costs: least audit.

1. Equal rows of a conversation are one row with a number of copies, counted with partial sums. A row that has the role and text of
   an earlier turn is a duplicate: first turns are aggregated, stored and joined back, so that Spark can split the join.
2. Rows are dealt out by ranges of (conversation, turn, role, text), so a conversation with a third of all rows is spread over
   as many tasks. Tasks read them in order. A conversation inside a range and of at most `rows` rows and `chars` characters is solved.
3. Of others each segment is an item for every pair of states, its lightest derivation from one to the other. These items are
   folded in order, conversation by conversation, one segment in memory at a time; SHA-256 is serial, and is kept for each of the
   four states. The way back names each segment's edits, which are then applied in parallel.

Rows go by turn, null first, then by role and text. A null conversation is one of its own. Null role or text is one space; a role
that does not begin with s, u or a has no place and is reroled or deleted. Conversations all of whose rows have no copies have zeros
and an empty audit. An audit is one value, so a conversation's audit must fit in memory. Extra columns are left out. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.session import stored

ROWS, CHARS = 512, 1 << 22
SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT, GOAL = range(5)
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

Weight = tuple[int, str]
Item = tuple[int, int]


@dataclass(frozen=True)
class Row:
    turn: int | None
    role: str
    text: str
    copies: int
    again: bool  # an earlier turn has this role and text

    @property
    def fault(self) -> str | None:
        body = self.text.rstrip(SPACE)
        return "blank" if not body else "duplicate" if self.again else "truncated" if body[-1] not in ".!?" else None

    def edits(self) -> list[tuple[Weight, str | None]]:
        """The row's axioms: weights, and the initial that the result has; None if nothing is left, "" if it may be u or a. All
        copies but the first are duplicates; that they go before anything is inserted gives the least audit."""
        more, cost = "D" * (self.copies - 1), DELETE * (self.copies - 1)
        if self.fault in ("blank", "duplicate"):
            return [((DELETE + cost, "D" + more), None)]
        stays = cost + (TRUNCATED if self.fault else 0)
        return [((KEEP + stays, "K" + more), self.role[:1] or "-"), ((REROLE + stays, "R" + more), ""), ((DELETE + cost, "D" + more), None)]


def superior(x: Weight, y: Weight) -> Weight:
    return x[0] + y[0], x[1] + y[1]


def finalise(axioms: Iterable[tuple[Item, Weight]], conclude: Callable[[Item, Weight], Iterable[tuple[Item, Weight]]], goal: Item | None = None) -> dict[Item, Weight]:
    """Knuth's agenda: items in the order of their lightest derivations, until the goal or, without one, until nothing follows."""
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict[Item, Weight] = {}
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if item == goal:
            break
        for head, heavier in conclude(item, weight):
            if head not in final:
                heapq.heappush(agenda, (heavier, head))
    return final


def derive(rows: list[Row], start: int, whole: bool) -> dict[int, Weight]:
    """The lightest derivations from `start` over all rows to each state, or only to the goal if the rows are a whole conversation."""
    edits, n = [r.edits() for r in rows], len(rows)

    def conclude(item: Item, weight: Weight) -> Iterator[tuple[Item, Weight]]:
        i, state = item
        wanted = AFTER[state, WANTED[state][0]]
        yield (i, wanted), superior(weight, (INSERT, "I"))
        if i < n:
            for edit, initial in edits[i]:
                to = state if initial is None else wanted if initial == "" else AFTER.get((state, initial))
                if to is not None:
                    yield (i + 1, to), superior(weight, edit)
        elif whole and state in (NOTHING, ASSISTANT):
            yield (n, GOAL), weight

    final = finalise([((0, start), (0, ""))], conclude, (n, GOAL) if whole else None)
    return {state: weight for (i, state), weight in final.items() if i == n and (state == GOAL or not whole)}


def apply(rows: list[Row], state: int, audit: str) -> Iterator[tuple[str, str]]:
    """The turns that the edits make of the rows."""
    i = done = 0
    for letter in audit:
        if letter == "I":
            yield WANTED[state], ""
            state = AFTER[state, WANTED[state][0]]
            continue
        row, done = rows[i], done + 1
        if done == row.copies:
            i, done = i + 1, 0
        if letter == "K":
            yield row.role, row.text
            state = AFTER[state, row.role[0]]
        elif letter == "R":
            yield WANTED[state], row.text
            state = AFTER[state, WANTED[state][0]]


def update(digest: Any, rows: list[Row], state: int, audit: str) -> Any:
    """Add the repaired lines; there is a line before unless the state is NOTHING."""
    between = "" if state == NOTHING else "\n"
    for role, text in apply(rows, state, audit):
        digest.update(f"{between}{role}:{text}".encode())
        between = "\n"
    return digest


@dataclass
class Tally:
    """Faults and gaps over rows in order."""

    first: int | None = None
    last: int | None = None
    turns: int = 0
    initial: str | None = None
    illegal: int = 0
    faults: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0})

    def add(self, rows: list[Row]) -> None:
        for r in rows:
            if r.turn is not None and r.turn != self.last:
                self.first = r.turn if self.first is None else self.first
                self.last, self.turns = r.turn, self.turns + 1
            if self.initial is not None and self.initial + r.role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = r.role[:1]
            self.illegal += r.copies - 1
            if r.fault:
                self.faults[r.fault] += 1
            self.faults["blank" if r.fault == "blank" else "duplicate"] += r.copies - 1

    def values(self) -> tuple[int, ...]:
        gaps = 0 if self.last is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return (gaps, *self.faults.values(), self.illegal)


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with some of them spoilt by a hash of conversation and turn, and `copies`: 0 for a row that is dropped."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space(conv), F.lit(":"), or_space(turn)).cast("binary")) % 20
    spoilt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space(text), "[.!?]", "")).otherwise(or_space(text))
    return df.select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(or_space(role)).alias(role), spoilt.alias(text),
                     F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


@dataclass(frozen=True)
class Repaired:
    """`summary`: a row for each conversation: SUMMARY, audit, repaired_sha256. `turns`: conversation, role and text, in the
    order of part, no and n."""

    summary: DataFrame
    turns: DataFrame


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None,
           rows: int = ROWS, chars: int = CHARS) -> Repaired:
    """Repair all conversations of `df`; `copies` may name a column with the number of times a row is there."""
    number = (F.col(copies) if copies else F.lit(1)).cast("long")
    gone = number == 0  # such rows only tell that the conversation is there
    text_of = lambda c: F.when(gone, "").otherwise(F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    counted = df.select(F.col(conv).alias("conv"), F.when(~gone, F.col(turn).cast("long")).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"), number.alias("copies"))
    counted = counted.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    counted = stored(counted.withColumn("same", F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    several = counted.where("copies > 0").groupBy("conv", "same").agg(F.count("*").alias("n"), F.min(when).alias("first")).where("n > 1")
    several = stored(several.select(F.col("conv").alias("c"), F.col("same").alias("s"), "first"), "several")
    marked = counted.join(several, counted["conv"].eqNullSafe(several["c"]) & (counted["same"] == several["s"]), "left")
    marked = stored(marked.select("conv", "turn", "role", "text", "copies", (F.col("first").isNotNull() & ~when.eqNullSafe(F.col("first"))).alias("again")), "turns")
    spread = marked.repartitionByRange("conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", "turn", "role", "text")

    kind = marked.schema["conv"].dataType
    one = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("again", T.BooleanType())])
    derived = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    key = [T.StructField("conv", kind), T.StructField("part", T.IntegerType()), T.StructField("no", T.IntegerType())]
    result = [*[T.StructField(c, T.LongType()) for c in SUMMARY], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    solved = stored(spread.mapInArrow(_solve(rows, chars), T.StructType([*key, *result, T.StructField("rows", T.ArrayType(one)), T.StructField("items", T.ArrayType(derived))])), "repaired")

    segments = solved.where("items IS NOT NULL")
    edits = T.StructType([*key, *result, T.StructField("start", T.IntegerType()), T.StructField("piece", T.StringType())])
    folded = segments.select("conv", "part", "no", "rows", "items").repartition("conv").sortWithinPartitions("conv", "part", "no").mapInArrow(_fold, edits)
    folded = stored(folded, "folded")
    names = [F.col("conv").alias(conv), *SUMMARY, "audit", "repaired_sha256"]
    summary = solved.where("items IS NULL").select(*names).unionByName(folded.where("piece IS NULL").select(*names))

    ways = folded.where("piece IS NOT NULL").select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("no").alias("k"), "start", "piece")
    parts = segments.join(ways, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("no") == F.col("k")))
    whole = solved.where("items IS NULL").withColumns({"start": F.lit(NOTHING), "piece": F.col("audit")})
    chosen = [c.name for c in key] + ["start", "piece", "rows"]
    out = T.StructType([*key, T.StructField("n", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    turns = whole.select(*chosen).unionByName(parts.select(*chosen)).mapInArrow(_turns, out)
    return Repaired(summary, turns.select(F.col("conv").alias(conv), "part", "no", "n", F.col("role").alias(role), F.col("text").alias(text)))


def _as_rows(values: list[dict]) -> list[Row]:
    return [Row(**v) for v in values]


def _plain(rows: list[Row]) -> list[dict]:
    return [{"turn": r.turn, "role": r.role, "text": r.text, "copies": r.copies, "again": r.again} for r in rows]


def _batch(out: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o.get(f.name) for o in out], f.type) for f in like], schema=like)


_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("again", pa.bool_())]))
_ITEMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_RESULT = [*[(c, pa.int64()) for c in SUMMARY], ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _summary(tally: Tally, weight: Weight, digest: str) -> dict:
    return {**dict(zip(SUMMARY, (*tally.values(), weight[0]))), "audit": weight[1], "repaired_sha256": digest}


def _solve(most_rows: int, most_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Results of conversations that lie inside the task's range, and segments of the others. Sorted rows come in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, at, inside = TaskContext.get().partitionId(), 0, None, False
        held: list[Row] = []
        chars, cut, out, schema = 0, False, [], None

        def segment() -> dict:
            nonlocal no, held, chars
            items = [{"start": q, "end": z, "cost": w[0], "audit": w[1]} for q in range(4) for z, w in derive(held, q, False).items()]
            made = {"conv": at[0], "part": part, "no": no, "rows": _plain(held), "items": items}
            no, held, chars = no + 1, [], 0
            return made

        def close(last: bool) -> dict:
            """A conversation that began after the first one and ends before the last one is whole."""
            nonlocal no, held, chars
            if cut or last or not inside:
                return segment()
            weight, tally = derive(held, NOTHING, True)[GOAL], Tally()
            tally.add(held)
            digest = update(hashlib.sha256(), held, NOTHING, weight[1]).hexdigest()
            made = {"conv": at[0], "part": part, "no": no, "rows": _plain(held), **_summary(tally, weight, digest)}
            no, held, chars = no + 1, [], 0
            return made

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("conv"), ("part", pa.int32()), ("no", pa.int32()), *_RESULT, ("rows", _ROWS), ("items", _ITEMS)])
            for conv, turn, role, text, copies, again in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "again")]):
                if at is None or at[0] != conv:
                    if at is not None:
                        out.append(close(False))
                        inside = True
                    at, cut = (conv,), False
                if copies:
                    held.append(Row(turn, role, text, copies, again))
                    chars += len(text)
                    if len(held) >= most_rows or chars >= most_chars:
                        out.append(segment())
                        cut = True
            if out:
                yield _batch(out, schema)
                out = []
        if at is not None:
            yield _batch([close(True)], schema)

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the segments of each conversation, in order. States: weight, digest so far, and the way as (way before, part, no, start, piece)."""
    at, schema, states, tally = None, None, {}, Tally()

    def close() -> list[dict]:
        weight, digest, way = min((states[q] for q in (NOTHING, ASSISTANT) if q in states), key=lambda s: s[0])
        out = [{"conv": at[0], **_summary(tally, weight, digest.hexdigest())}]
        while way is not None:
            way, part, no, start, piece = way
            out.append({"conv": at[0], "part": part, "no": no, "start": start, "piece": piece})
        return out

    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv"), ("part", pa.int32()), ("no", pa.int32()), *_RESULT, ("start", pa.int32()), ("piece", pa.string())])
        for i, conv in enumerate(batch.column("conv").to_pylist()):
            part, no, values, items = (batch.column(c)[i].as_py() for c in ("part", "no", "rows", "items"))
            if at is None or at[0] != conv:
                if at is not None:
                    yield _batch(close(), schema)
                at, states, tally = (conv,), {NOTHING: ((0, ""), hashlib.sha256(), None)}, Tally()
            rows = _as_rows(values)
            tally.add(rows)
            best: dict[int, tuple[Weight, int, str]] = {}
            for item in items:
                if (before := states.get(item["start"])) is not None:
                    weight = superior(before[0], (item["cost"], item["audit"]))
                    if item["end"] not in best or weight < best[item["end"]][0]:
                        best[item["end"]] = weight, item["start"], item["audit"]
            states = {end: (weight, update(states[start][1].copy(), rows, start, piece), (states[start][2], part, no, start, piece)) for end, (weight, start, piece) in best.items()}
    if at is not None:
        yield _batch(close(), schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv"), ("part", pa.int32()), ("no", pa.int32()), ("n", pa.int32()), ("role", pa.string()), ("text", pa.string())])
        for i, conv in enumerate(batch.column("conv").to_pylist()):
            part, no, start, piece, values = (batch.column(c)[i].as_py() for c in ("part", "no", "start", "piece", "rows"))
            made = [{"conv": conv, "part": part, "no": no, "n": n, "role": r, "text": t} for n, (r, t) in enumerate(apply(_as_rows(values), start, piece))]
            yield _batch(made, schema)
