"""Structure repair of conversations: faults of turns, and the cheapest edits to legal roles.

Method: Dijkstra on the implicit (turn index, grammar state) edit lattice (``turn_lattice``), priority key
(cost, audit), stopping at the first popped accepting end node.

No conversation has to fit into a task. Equal rows are counted into one first. Rows are then dealt by
ranges of (conversation, turn, role, text), so a conversation of a third of all rows lies over many tasks,
and each task streams its range in order:

* a conversation that lies within one range and has up to ``PIECE`` turns is searched and rewritten there;
* of others each run of up to ``PIECE`` turns is a piece with its cheapest ways between all pairs of states,
  found by the same search. Pieces without their texts are chained by conversation: a task that streams
  them keeps the best way to each state. The audit then meets the texts, again as a stream in order; the hash of a
  repaired conversation is one sequential sum, so that is the one task a conversation has, and it
  holds one piece and the audit at a time.

Whether a role and text was seen earlier comes from an aggregate by a 256-bit hash of both, joined back, not from state.

Rows are ordered by turn, nulls first; rows of equal turns by role, then text (a repeated row of the table is a
duplicate). A null conversation id is a conversation of its own. Null roles and texts are one space, and so is a null
turn within the text that damage is drawn by. Texts are taken whole. An empty table gives an empty result,
further columns are not read. A conversation without rows after damage has zeros, an empty audit and the
empty text's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import functions as F

from lacuna.llm import turn_lattice as tl
from lacuna.llm.wordblock import keep

#: Turns of a conversation that are searched at once.
PIECE = 256
#: Bytes of texts that a piece holds, beyond one turn.
PIECE_BYTES = 1 << 20
#: Repaired rows that a task gives out at a time.
OUT_ROWS = 500

COUNTS = ("blank", "duplicate", "truncated")
_STATS = "conv_id long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, initials string"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_STEP = "struct<f:int,t:int,cost:long,letters:string>"
#: A row of the first pass: a whole result, or a piece (``part``, ``no`` order the pieces).
RUNS = f"done boolean, part int, no int, {_STATS}, gaps long, cost long, audit string, repaired_sha256 string, steps array<{_STEP}>, turn array<struct<role:string,text:string>>"
_BLANK = "^[\\x20\\x09-\\x0D]*\\z"


def damaged(conversations):
    """(conv_id, turn, role, text, copies) as crc32 of ``conv_id:turn`` modulo 20 has it."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    rows = rows.withColumn("how", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows):
    """Each distinct (conv_id, turn, role, text) with its number, the fault of the first of them and that of the others."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    one = one.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    first = one.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    seen = one.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    blank = F.regexp_like("text", F.lit(_BLANK))
    cut = ~F.regexp_like("text", F.lit("[.!?][\\x20\\x09-\\x0D]*\\z"))
    later = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(blank, tl.BLANK).when(later, tl.DUPLICATE).when(cut, tl.CUT).otherwise(tl.SOUND)
    return seen.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), F.when(blank, tl.BLANK).otherwise(tl.DUPLICATE).alias("again"))


class _Run:
    """Turns of one conversation, in order, with what is counted over them."""

    def __init__(self, conv_id):
        self.conv_id, self.low, self.high, self.turns = conv_id, None, None, 0
        self.faults, self.lines, self.bytes = [], [], 0
        self._last = None

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.faults.append((role[:1] or " ", fault))
        gone = fault in (tl.BLANK, tl.DUPLICATE)
        self.lines.append({"role": role, "text": "" if gone else text})
        self.bytes += len(self.lines[-1]["text"])

    def row(self) -> dict:
        kinds = [f for _, f in self.faults]
        initials = "".join(i for i, _ in self.faults)
        counts = {"blank": kinds.count(tl.BLANK), "duplicate": kinds.count(tl.DUPLICATE), "truncated": kinds.count(tl.CUT)}
        return {"conv_id": self.conv_id, "low": self.low, "high": self.high, "turns": self.turns, "initials": initials[:1] + initials[-1:], "illegal": tl.illegal(initials)} | counts

    def piece(self, part: int, no: int) -> dict:
        steps = [dict(zip(("f", "t", "cost", "letters"), s, strict=True)) for s in tl.through(self.faults)]
        return self.row() | {"done": False, "part": part, "no": no, "steps": steps, "turn": self.lines}

    def whole(self) -> dict:
        cost, audit = tl.cheapest(tl.search(self.faults))
        edit = tl.Rewriter(audit)
        lines = [x for t in self.lines for x in edit.feed(t["role"], t["text"])] + edit.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.row() | {"done": True, "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:  # few rows at a time as Python objects
            part = batch.slice(at, 1000)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)
            at += 1000


def _given_out(rows: Iterator[dict], schema: pa.Schema, size=len) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 1 + size(r)
        if weight >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _cut(schema: pa.Schema, piece: int, piece_bytes: int):
    """First pass over a range of rows in order."""

    def pieces(rows: Iterator[tuple], part: int) -> Iterator[dict]:
        no, run, alone = 0, None, False
        # a run is whole if it began after the range's first conversation and ends before its last
        for conv_id, turn, role, text, copies, fault, again in rows:
            if run is None or run.conv_id != conv_id:
                if run is not None:
                    yield run.whole() if alone else run.piece(part, no)
                    no += 1
                alone = run is not None
                run = _Run(conv_id)
            for k in range(copies):
                if len(run.faults) >= piece or run.bytes >= piece_bytes:
                    yield run.piece(part, no)
                    no, alone = no + 1, False
                    run = _Run(conv_id)
                run.add(turn, role, text, again if k else fault)
        if run is not None:
            yield run.piece(part, no)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = _rows(batches, "conv_id", "turn", "role", "text", "copies", "fault", "again")
        yield from _given_out(pieces(rows, TaskContext.get().partitionId()), schema, lambda r: len(r.get("turn") or ()))

    return run


def _chain(schema: pa.Schema):
    """Stats and cheapest edits of each conversation from its pieces in order."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (r for b in batches for at in range(0, b.num_rows, 16) for r in b.slice(at, 16).to_pylist())
        for conv_id, pieces in tl.runs(rows, lambda r: r["conv_id"]):
            best, total, high, last = {tl.START: (0, "")}, dict.fromkeys((*COUNTS, "illegal"), 0), None, ""
            low, turns = None, 0
            for p in pieces:
                best = tl.follow(best, [(s["f"], s["t"], s["cost"], s["letters"]) for s in p["steps"]])
                for c in total:
                    total[c] += p[c]
                total["illegal"] += tl.illegal(last + p["initials"][:1])
                last = p["initials"][-1:]
                if p["low"] is not None:
                    low = p["low"] if low is None else low
                    turns += p["turns"] - (p["low"] == high)
                    high = p["high"]
            cost, audit = tl.cheapest(best)
            yield total | {"conv_id": conv_id, "gaps": 0 if low is None else high - low + 1 - turns, "cost": cost, "audit": audit}

    return lambda batches: _given_out(chained(batches), schema, lambda r: len(r["audit"]) >> 10)


def _hash(schema: pa.Schema):
    """The hash of each repaired conversation: its audit comes first, then its pieces in order."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist())
        for _, own in tl.runs(rows, lambda r: r["conv_id"]):
            head = next(own)
            edit, sha, first = tl.Rewriter(head["audit"]), hashlib.sha256(), True
            lines = chain((x for p in own for t in p["turn"] for x in edit.feed(t["role"], t["text"])), (x for _ in (0,) for x in edit.close()))
            for line in lines:
                sha.update(line.encode() if first else b"\n" + line.encode())
                first = False
            yield {k: head[k] for k in schema.names if k != "repaired_sha256"} | {"repaired_sha256": sha.hexdigest()}

    return lambda batches: _given_out(hashed(batches), schema, lambda r: len(r["audit"]) >> 10)


def repair(conversations, piece: int = PIECE, piece_bytes: int = PIECE_BYTES):
    """One row for each original conversation: counts of faults, cost and letters of the cheapest edits, hash of the repaired turns."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ordered = judged(damaged(conversations)).repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = ordered.select("conv_id", "turn", "role", "text", "copies", "fault", "again")
    first = keep(ordered.mapInArrow(_cut(_arrow(RUNS), piece, piece_bytes), RUNS), "turns")
    names = [c.split()[0] for c in _RESULT.split(", ")]
    done = first.where("done").select(names)
    pieces = first.where("not done")

    audits = ", ".join(c for c in _RESULT.split(", ") if not c.startswith("repaired"))
    order = ("conv_id", "part", "no")
    by_conv = lambda df: df.repartition("conv_id").sortWithinPartitions(*order)
    chained = by_conv(pieces.select(*order, "low", "high", "turns", *COUNTS, "illegal", "initials", "steps")).mapInArrow(_chain(_arrow(audits)), audits)
    heads = chained.withColumns({"part": F.lit(-1), "no": F.lit(-1), "turn": F.lit(None).cast("array<struct<role:string,text:string>>")})
    bodies = pieces.select(*order, "turn")
    rest = by_conv(heads.unionByName(bodies, allowMissingColumns=True)).mapInArrow(_hash(_arrow(_RESULT)), _RESULT)

    found = done.unionByName(rest).withColumnRenamed("conv_id", "c")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names[1:7]]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
