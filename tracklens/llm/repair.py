"""Repair of the structure of conversations by a forward Viterbi search over four grammar states.

A conversation is right if its roles' initials read (s?(ua)+)?: the states are nothing yet, after s,
after u, after a.  Turns are kept (cost 0), given the role user or assistant (2) or
deleted (3); an empty user or assistant turn may be inserted anywhere (2).  Blank and
repeated turns must be deleted; a truncated one costs 1 more unless it is.  For
each state the search carries the least (cost, audit), audit being the initials of the
edits so far (K, R, D, I), and closes each turn's layer with insertions: from a
state two of them reach all others, so one sweep over the states in order suffices.  Of equal
costs the audit least in ASCII wins.  With equal costs no audit is the beginning of another
(it would differ by insertions, which cost), so what is best for a prefix stays best, and an audit tells its roles.

No task needs a whole conversation.  Turns are sorted over ranges of (conv_id, turn, role,
text), so a long conversation lies in many neighbouring partitions, and each run of at most SEGMENT_TURNS turns or
SEGMENT_CHARS characters (or one longer turn) becomes a segment: the search runs from each state that
its conversation may be in before.  Segments are then put together in order, four strings at a time,
and each learns its part of the best audit.

Defined cases: a null turn comes first, turns of one number are ordered by role, then text; null roles
and texts are one space, an empty role cannot be kept; null conv_ids are one conversation.  Equal rows follow each other, all but the first are
repeated ones.  An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bounds of a segment.
SEGMENT_TURNS, SEGMENT_CHARS = 1024, 1 << 20
#: The states reached from each state by a role's initial; the first is the start, the last is the end.
START, END = 0, 3
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Path = tuple[int, str] | None


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its
    text, 2 takes its .!? away, 3 repeats it, 4 makes its role user.  Nulls are one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    out = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def _sorted(rows: DataFrame) -> DataFrame:
    """rows with blank, truncated and repeated (an earlier turn has the same role and text), in order over ranges."""
    clean = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)  # the last sign that is no white space
    said = F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    clean = clean.withColumns({"blank": last == "", "truncated": ~last.isin(".", "!", "?"), "said": F.unhex(said)})
    first = clean.groupBy("said").agg(F.min(F.struct("turn")).alias("first"))  # null turns first
    clean = clean.join(first, "said").withColumn("repeated", ~F.col("turn").eqNullSafe(F.col("first.turn"))).drop("said", "first")
    return clean.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")


def _better(paths: list[Path], state: int, found: tuple[int, str]) -> None:
    if paths[state] is None or found < paths[state]:
        paths[state] = found


def _closed(paths: list[Path]) -> list[Path]:
    """paths, and those with turns inserted after them."""
    for state, after in enumerate(AFTER):
        if paths[state] is not None:
            cost, audit = paths[state]
            for initial in ROLES:
                if initial in after:
                    _better(paths, after[initial], (cost + INSERT, audit + "I"))
    return paths


def search(turns: Iterable[tuple[str, str]], entry: int) -> list[Path]:
    """The least (cost, audit) into each state from ``entry`` over turns (initial of the role, fault: '', b, d or t)."""
    paths = _closed([(0, "") if s == entry else None for s in range(len(AFTER))])
    for initial, fault in turns:
        reached: list[Path] = [None] * len(AFTER)
        extra = TRUNCATED if fault == "t" else 0
        for state, path in enumerate(paths):
            if path is None:
                continue
            cost, audit = path
            _better(reached, state, (cost + DELETE, audit + "D"))
            if fault in ("b", "d"):
                continue
            after = AFTER[state]
            if initial in after:
                _better(reached, after[initial], (cost + extra, audit + "K"))
            for other in ROLES:
                if other in after:
                    _better(reached, after[other], (cost + REROLE + extra, audit + "R"))
        paths = _closed(reached)
    return paths


def edited(turns: list[dict], audit: str, state: int) -> list[dict]:
    """The turns left after the edits, from ``state`` on; inserted ones are empty."""
    out, at = [], 0
    for edit in audit:
        turn = None if edit == "I" else turns[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            initial, turn = turn["role"][:1], {"edit": edit, "role": turn["role"], "text": turn["text"]}
        else:
            initial = next(i for i in ROLES if i in AFTER[state])
            turn = {"edit": edit, "role": ROLES[initial], "text": "" if turn is None else turn["text"]}
        state = AFTER[state][initial]
        out.append(turn)
    return out


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PATHS = pa.list_(pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))
_SEGMENT = [("segment", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("distinct_turns", pa.int64()), ("paths", _PATHS), ("turns", _TURNS)]
_CHOSEN = [("segment", pa.int64()), ("state", pa.int32()), ("audit", pa.string()), ("last", pa.bool_()), *((c, pa.int64()) for c in COUNTS)]
_DIGEST = [*((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
_SEGMENT_SQL = "segment bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, lo bigint, hi bigint, distinct_turns bigint, paths array<array<struct<cost:bigint,audit:string>>>, turns array<struct<role:string,text:string>>"
_CHOSEN_SQL = "segment bigint, state int, audit string, last boolean, " + ", ".join(f"{c} bigint" for c in COUNTS)
_REPAIRED_SQL = _CHOSEN_SQL + ", turns array<struct<edit:string,role:string,text:string>>"


def _batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as record batches of bounded size."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= 4 * SEGMENT_CHARS or len(held) >= SEGMENT_TURNS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _streamed(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, dict]]], fields: list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over a partition's batches by ``rows``; the result has conv_id and the fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        one = next(batches, None)
        if one is not None:
            yield from _batches(rows(chain([one], batches)), pa.schema([("conv_id", one.schema.field("conv_id").type), *fields]))

    return run


def _segment(conv: object, number: int, turns: list[dict], first: bool) -> tuple[int, dict]:
    """A segment's row; the search runs from the start alone if no segment goes before."""
    initials = [t["role"][:1] for t in turns]
    faults = ["b" if t["blank"] else "d" if t["repeated"] else "t" if t["truncated"] else "" for t in turns]
    given = [t["turn"] for t in turns if t["turn"] is not None]
    paths = []
    for entry in range(len(AFTER)):
        found = search(zip(initials, faults, strict=True), entry) if entry == START or not first else [None] * len(AFTER)
        paths.append([None if p is None else {"cost": p[0], "audit": p[1]} for p in found])
    counts = {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))}
    ends = {"first_initial": initials[0], "last_initial": initials[-1], "lo": min(given, default=None), "hi": max(given, default=None), "distinct_turns": len(set(given))}
    return sum(len(t["text"]) + 16 for t in turns), {"conv_id": conv, "segment": number, **counts, **ends, "paths": paths, "turns": [{"role": t["role"], "text": t["text"]} for t in turns]}


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, dict]]:
    number = TaskContext.get().partitionId() << 32
    turns, chars, before, first = [], 0, None, False
    for batch in batches:
        for row in batch.to_pylist():
            same = before is not None and row["conv_id"] == before["conv_id"]
            if turns and (not same or len(turns) >= most or chars + len(row["text"]) > SEGMENT_CHARS):
                yield _segment(before["conv_id"], number, turns, first)
                number, turns, chars, first = number + 1, [], 0, not same
            row["repeated"] = row["repeated"] or same and (row["turn"], row["role"], row["text"]) == (before["turn"], before["role"], before["text"])
            turns.append(row)
            chars += len(row["text"])
            before = row
    if turns:
        yield _segment(before["conv_id"], number, turns, first)


def segments(rows: DataFrame, most: int = SEGMENT_TURNS) -> DataFrame:
    """The segments of all conversations, in the order of their numbers."""
    ordered = _sorted(rows)
    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_streamed(partial(_cut, most=most), _SEGMENT), f"conv_id {kind}, {_SEGMENT_SQL}")


class _Fold:
    """Puts a conversation's segments together: per state the least (cost, audit) and its steps (segment, entry, audit)."""

    def __init__(self, conv: object) -> None:
        self.conv = conv
        self.paths: list[tuple[int, str, tuple] | None] = [(0, "", ()) if s == START else None for s in range(len(AFTER))]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct_turns"), 0)
        self.lo = self.hi = self.initial = None

    def add(self, row: dict) -> None:
        reached: list[tuple[int, str, tuple] | None] = [None] * len(AFTER)
        for entry, path in enumerate(self.paths):
            for state, more in enumerate(row["paths"][entry]):
                if path is not None and more is not None:
                    found = (path[0] + more["cost"], path[1] + more["audit"])
                    if reached[state] is None or found < reached[state][:2]:
                        reached[state] = (*found, (path[2], row["segment"], entry, more["audit"]))
        self.paths = reached
        for c in self.counts:
            self.counts[c] += row[c]
        self.counts["illegal"] += self.initial is not None and self.initial + row["first_initial"] not in LEGAL
        self.counts["distinct_turns"] -= self.hi is not None and self.hi == row["lo"]
        self.initial = row["last_initial"]
        self.lo = row["lo"] if self.lo is None else self.lo
        self.hi = self.hi if row["hi"] is None else row["hi"]

    def rows(self) -> Iterator[tuple[int, dict]]:
        cost, _, steps = min(p for p in (self.paths[START], self.paths[END]) if p is not None)
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.counts["distinct_turns"]
        told = {"gaps": gaps, "cost": cost, **{c: self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")}}
        parts = []
        while steps:
            steps, *part = steps
            parts.append(part)
        for k, (segment, entry, audit) in enumerate(parts):  # the last segment comes first
            yield len(audit) + 64, {"conv_id": self.conv, "segment": segment, "state": entry, "audit": audit, "last": k == 0, **told}


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    fold = None
    for batch in batches:
        for row in batch.to_pylist():
            if fold is None or fold.conv != row["conv_id"]:
                if fold is not None:
                    yield from fold.rows()
                fold = _Fold(row["conv_id"])
            fold.add(row)
    if fold is not None:
        yield from fold.rows()


def repair(rows: DataFrame, most: int = SEGMENT_TURNS) -> DataFrame:
    """Repaired conversations in segments: conv_id, segment (their order), turns (edit, role,
    text), audit (the segment's part) and, of the whole conversation, gaps, blank,
    duplicate, truncated, illegal and cost.

    rows: conv_id, turn, role, text; most: turns of a segment.  illegal counts neighbouring turns whose initials are not su, ua or au; gaps
    the numbers that are missing between the least and the greatest turn.
    """
    cut = written(segments(rows, most), "turn-segments")
    kind = cut.schema["conv_id"].dataType.simpleString()
    narrow = cut.drop("turns").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    chosen = narrow.mapInArrow(_streamed(_folded, _CHOSEN), f"conv_id {kind}, {_CHOSEN_SQL}")
    both = chosen.join(cut.select("segment", "turns"), "segment").select("conv_id", *[c.split()[0] for c in _CHOSEN_SQL.split(", ")], "turns")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns = [edited(t, a, s) for t, a, s in zip(batch["turns"].to_pylist(), batch["audit"].to_pylist(), batch["state"].to_pylist(), strict=True)]
            yield batch.drop_columns(["turns"]).append_column("turns", pa.array(turns, kinds))

    return both.mapInArrow(apply, f"conv_id {kind}, {_REPAIRED_SQL}").drop("state")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    digest, audit, empty = hashlib.sha256(), [], True
    for batch in batches:
        for row in batch.to_pylist():
            for turn in row["turns"]:
                digest.update(("" if empty else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
                empty = False
            audit.append(row["audit"])
            if row["last"]:
                yield len(audit) + 64, {"conv_id": row["conv_id"], **{c: row[c] for c in COUNTS}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                digest, audit, empty = hashlib.sha256(), [], True


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each repaired conversation: its counts, the whole audit and repaired_sha256, of
    its ``role:text`` joined by newlines, read segment by segment."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(_streamed(_digests, _DIGEST), f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """Damages rows, repairs them, and tells of every conv_id of rows; zeros, an empty audit and the hash of nothing where no turn is left."""
    found = digests(repair(damage(rows)))
    found = found.withColumnRenamed("conv_id", "__conv")
    every = rows.select("conv_id").distinct()
    both = every.join(found, every["conv_id"].eqNullSafe(found["__conv"]), "left")
    nothing = hashlib.sha256().hexdigest()
    return both.select("conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
