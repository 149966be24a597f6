"""Repair of conversation structure by weighted CYK parsing over spans of turns.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``: an optional
system turn, then user and assistant in turn.  The cheapest edits that make it so are found
by interval parsing.

Grammar.  The nonterminals ``[p, q]`` stand for what leads the pattern from state p to state
q; the binary rules are ``[p, q] -> [p, r] [r, q]`` and a terminal is one turn: kept, given
another role, or deleted.  Insertions are closed over in the terminals: a turn's cells are
``C * M * C`` with the cheapest insertions C between any two states.  C * C = C, so nothing
is left to insert when spans meet.

Chart.  A span's cell holds the least (cost, audit) for each nonterminal, where the audit is
the edits' initials in order.  Spans are combined bottom-up by length.  Nonterminals carry the
state on either side, so any derivation of a span can be cut at any place, and one cut per
span gives the cells that all cuts give; lengths therefore double from level to level.  Among equal
costs no audit begins another (what is left over would be insertions, which cost), so the
least audit of a span is made of least audits of its parts.

In Spark.  Turns without their texts are sorted by conversation and place across range
partitions, so a conversation of any length is dealt to many tasks; each parses segments of
at most ``segment`` turns, and the segments' cells are combined per conversation.  Texts move once, to
meet the audits, and stream through: a task holds one batch and its conversation's audit.  A
digest is over a whole conversation in order, so its texts pass one task.

Defined cases.  A null conversation id is a conversation of its own; a null role or text
counts as one space; null turns come first.  Turns with the same number follow by role,
then by their text's first ``BEGINNING`` characters, then by its digest.  Conversations without
turns have no faults and an empty audit.  Very long texts are only compared and hashed by Spark and pass
Python batch by batch.  Rows repeated in full are duplicates.  No rows give no rows.  Only the
four named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.plans.durable import materialise

SEGMENT = 4096
BEGINNING = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# States of the pattern: nothing yet, after s, after u, after a.
_STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_N, _START, _ENDS = len(_STEPS), 0, (0, 3)
_ROLES = {"u": "user", "a": "assistant"}
_LEGAL = ("su", "ua", "au")

# (cost, audit) by [p * _N + q]; None where q cannot be reached.
Cells = tuple


def joined(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans together: the least (cost, audit) over the state between them."""
    out = [None] * (_N * _N)
    for p in range(_N):
        for r in range(_N):
            a = left[p * _N + r]
            if a is None:
                continue
            for q in range(_N):
                b = right[r * _N + q]
                if b is not None:
                    new, at = (a[0] + b[0], a[1] + b[1]), p * _N + q
                    if out[at] is None or new < out[at]:
                        out[at] = new
    return tuple(out)


def _insertions() -> Cells:
    """The cheapest insertions between any two states."""
    cells = [None] * (_N * _N)
    for p in range(_N):
        cells[p * _N + p] = (0, "")
        for role in _ROLES:
            if role in _STEPS[p]:
                cells[p * _N + _STEPS[p][role]] = (INSERT, "I")
    closed = tuple(cells)
    while (longer := joined(closed, closed)) != closed:
        closed = longer
    return closed


INSERTIONS = _insertions()


@lru_cache(maxsize=4096)
def turn_cells(initial: str, fault: str) -> Cells:
    """Cells of one turn; ``fault`` is ``b``lank, ``d``uplicate, ``t``runcated or nothing."""
    cells = [None] * (_N * _N)
    for p in range(_N):
        options = [(p, (DELETE, "D"))]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            options += [(_STEPS[p][initial], (KEEP + more, "K"))] if initial in _STEPS[p] else []
            options += [(_STEPS[p][role], (REROLE + more, "R")) for role in _ROLES if role in _STEPS[p]]
        for q, new in options:
            if cells[p * _N + q] is None or new < cells[p * _N + q]:
                cells[p * _N + q] = new
    return joined(joined(INSERTIONS, tuple(cells)), INSERTIONS)


def combined(spans: list[Cells]) -> Cells:
    """Cells of neighbouring spans together, bottom-up by length."""
    if not spans:
        return INSERTIONS
    while len(spans) > 1:
        level = [joined(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = level + spans[len(level) * 2:]
    return spans[0]


@lru_cache(maxsize=1 << 13)
def _short(turns: tuple[tuple[str, str], ...]) -> Cells:
    return combined([turn_cells(*t) for t in turns])


def parsed(turns: tuple[tuple[str, str], ...]) -> Cells:
    """Cells of the turns (initial, fault); short stretches, which recur, are remembered."""
    return combined([_short(turns[i:i + 32]) for i in range(0, len(turns), 32)])


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[_START * _N + q] for q in _ENDS if cells[_START * _N + q] is not None)


_PLACE = "turn, role, beginning, digest, duplicate"
_SEGMENT_TYPE = """first struct<turn:long,role:string,beginning:string,digest:binary,duplicate:boolean>,
    last struct<turn:long,role:string,beginning:string,digest:binary,duplicate:boolean>,
    n long, blank long, duplicated long, truncated long, illegal long, n_turns long, low long, high long,
    opening string, closing string, costs array<long>, audits array<string>"""


def _segments(kind: str, segment: int):
    """Maps sorted turns to parsed segments of one conversation each."""
    schema = pa.schema([("turn", pa.int64()), ("role", pa.string()), ("beginning", pa.string()), ("digest", pa.binary()),
                        ("duplicate", pa.bool_())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []

        def close() -> None:
            turns = [r for r in held if r["present"]]
            faults = ["b" if r["blank"] else "d" if r["duplicate"] else "" if r["ended"] else "t" for r in turns]
            initials = [r["role"][:1] for r in turns]
            numbers = [r["turn"] for r in turns if r["turn"] is not None]
            cells = parsed(tuple(zip(initials, faults)))
            place = lambda r: {c: r[c] for c in schema.names}
            out.append({
                "conv_id": held[0]["conv_id"], "first": place((turns or held)[0]), "last": place((turns or held)[-1]), "n": len(turns),
                "blank": faults.count("b"), "duplicated": faults.count("d"), "truncated": faults.count("t"),
                "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
                "n_turns": len(set(numbers)), "low": min(numbers, default=None), "high": max(numbers, default=None),
                "opening": initials[0] if turns else "", "closing": initials[-1] if turns else "",
                "costs": [None if c is None else c[0] for c in cells], "audits": [None if c is None else c[1] for c in cells]})
            held.clear()

        for batch in batches:
            kept_type = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if held and (row["conv_id"] != held[0]["conv_id"] or len(held) >= segment):
                    close()
                held.append(row)
            if len(out) >= 1024:
                yield _segment_batch(out, kept_type, schema)
                out.clear()
        if held:
            close()
        if out:
            yield _segment_batch(out, kept_type, schema)

    return parse, f"conv_id {kind}, {_SEGMENT_TYPE}"


def _segment_batch(rows: list[dict], kept_type: pa.DataType, place: pa.Schema) -> pa.RecordBatch:
    place_type, number = pa.struct(list(place)), pa.int64()
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(
        [("conv_id", kept_type), ("first", place_type), ("last", place_type)]
        + [(c, number) for c in ("n", "blank", "duplicated", "truncated", "illegal", "n_turns", "low", "high")]
        + [("opening", pa.string()), ("closing", pa.string()), ("costs", pa.list_(number)), ("audits", pa.list_(pa.string()))]))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _whole(segments: list[dict]) -> dict:
    """Counts, cost and audit of a conversation from its segments in order."""
    spans = [s for s in segments if s["n"]]
    if not spans:
        return dict.fromkeys(_COUNTS, 0) | {"audit": ""}
    pairs = list(zip(spans, spans[1:]))
    low, high = ([s[k] for s in spans if s[k] is not None] for k in ("low", "high"))
    # Turns are sorted, so a number occurs in two segments only where they meet.
    distinct = sum(s["n_turns"] for s in spans) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in pairs)
    cost, audit = cheapest(combined([tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"])) for s in spans]))
    return {"gaps": max(high) - min(low) + 1 - distinct if low else 0,
            "blank": sum(s["blank"] for s in spans), "duplicate": sum(s["duplicated"] for s in spans),
            "truncated": sum(s["truncated"] for s in spans),
            "illegal": sum(s["illegal"] for s in spans) + sum(a["closing"] + b["opening"] not in _LEGAL for a, b in pairs),
            "cost": cost, "audit": audit}


def _joined_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_whole(row.as_py()) for row in batch["segments"]]
        yield pa.record_batch([batch["conv_id"], *(pa.array([f[c] for f in found], pa.int64()) for c in _COUNTS),
                               pa.array([f["audit"] for f in found], pa.string())], names=["conv_id", *_COUNTS, "audit"])


def audits(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; ``turns`` as ``_turns`` gives them."""
    same = Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    marked = turns.withColumn("duplicate", F.row_number().over(same) > 1).drop("text")
    # Sampling for the ranges must not repeat the window.
    marked = materialise(marked, name="turns")
    places = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "beginning", "digest", "duplicate")]
    parse, schema = _segments(dict(turns.dtypes)["conv_id"], segment)
    segments = marked.repartitionByRange(*places).sortWithinPartitions(*places).mapInArrow(parse, schema)
    # A null field of a struct compares as the smallest, as null turns do.
    whole = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        *(c.split()[0] for c in ("first", "last", "n", "blank", "duplicated", "truncated", "illegal", "n_turns", "low", "high",
                                 "opening", "closing", "costs", "audits"))))).alias("segments"))
    return whole.mapInArrow(_joined_segments, f"conv_id {dict(turns.dtypes)['conv_id']}, "
                            + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")


def _turns(rows: DataFrame, present: Column | None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"), F.substring(text, 1, BEGINNING).alias("beginning"), F.unhex(F.sha2(text, 256)).alias("digest"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), text.rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"),
        F.coalesce(present, F.lit(False)).alias("present") if present is not None else F.lit(True).alias("present"))


class _Repair:
    """The edits of one audit applied to turns as they come."""

    def __init__(self, audit: str):
        self._audit, self._at, self._state = audit, 0, _START

    def _new_role(self) -> str:
        initial = next(r for r in _ROLES if r in _STEPS[self._state])
        self._state = _STEPS[self._state][initial]
        return _ROLES[initial]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self._audit[self._at:self._at + 1] == "I":
            self._at += 1
            yield self._new_role(), "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self._audit[self._at]
        self._at += 1
        if edit == "K":
            self._state = _STEPS[self._state][role[:1]]
            yield role, text, edit
        elif edit == "R":
            yield self._new_role(), text, edit


def _streamed(batches: Iterator[pa.RecordBatch]):
    """(type of ids, audit row, repaired turns, whether these are the conversation's last), piece by piece."""
    kind = head = repair = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if row["text"] is None:  # an audit, which comes before its turns
                if repair is not None:
                    yield kind, head, repair.inserted(), True
                head, repair = row, _Repair(row["audit"])
            else:
                yield kind, head, repair.turn(row["role"], row["text"]), False
    if repair is not None:
        yield kind, head, repair.inserted(), True


def _meeting(rows: DataFrame, present: Column | None, segment: int) -> tuple[DataFrame, str]:
    """Every conversation's audit row, followed by its turns in order."""
    turns, kind = _turns(rows, present), dict(rows.dtypes)["conv_id"]
    heads = audits(turns, segment).withColumns({"is_turn": F.lit(False), "turn": F.lit(None).cast("long")}).withColumns(
        {c: F.lit(None).cast(t) for c, t in (("role", "string"), ("text", "string"), ("beginning", "string"), ("digest", "binary"))})
    names = ["conv_id", "is_turn", "turn", "role", "text", "beginning", "digest", *_COUNTS, "audit"]
    bodies = turns.where("present").withColumns({"is_turn": F.lit(True), "audit": F.lit(None).cast("string"),
                                                 **{c: F.lit(None).cast("long") for c in _COUNTS}})
    order = [F.asc_nulls_first(c) for c in ("conv_id", "is_turn", "turn", "role", "beginning", "digest")]
    both = heads.select(names).unionByName(bodies.select(names)).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "role", "text", *_COUNTS, "audit"), kind


def repaired_turns(rows: DataFrame, present: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """conv_id, place, role, text, edit (K, R or I) of every turn after repair.

    ``rows`` has conv_id, turn, role and text; rows where ``present`` is not true take no part.
    """
    both, kind = _meeting(rows, present, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, kept_type = [], 0, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * 5
            held.clear()
            return pa.record_batch([pa.array(columns[0], kept_type), pa.array(columns[1], pa.int64()),
                                    *(pa.array(c, pa.string()) for c in columns[2:])], names=["conv_id", "place", "role", "text", "edit"])

        for kept_type, head, turns, last in _streamed(batches):
            for turn in turns:
                held.append((head["conv_id"], place, *turn))
                place += 1
            place = 0 if last else place
            if len(held) >= 512:
                yield batch()
        if held:
            yield batch()

    return both.mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


def repair_summary(rows: DataFrame, present: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """Per conversation, also those without a present row: counts, cost, audit and repaired_sha256,
    the digest of the repaired ``role:text`` joined by line feeds."""
    both, kind = _meeting(rows, present, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, n_turns, kept_type = [], hashlib.sha256(), 0, None

        def batch() -> pa.RecordBatch:
            found = list(held)
            held.clear()
            return pa.RecordBatch.from_pylist(found, schema=pa.schema([("conv_id", kept_type), *((c, pa.int64()) for c in _COUNTS),
                                                                       ("audit", pa.string()), ("repaired_sha256", pa.string())]))

        for kept_type, head, turns, last in _streamed(batches):
            for role, text, _ in turns:
                digest.update(f"{chr(10) if n_turns else ''}{role}:{text}".encode())
                n_turns += 1
            if last:
                held.append({k: head[k] for k in ("conv_id", *_COUNTS, "audit")} | {"repaired_sha256": digest.hexdigest()})
                digest, n_turns = hashlib.sha256(), 0
            if len(held) >= 1024:
                yield batch()
        if held:
            yield batch()

    return both.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")
