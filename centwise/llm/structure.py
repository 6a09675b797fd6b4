"""Conversation structure repair (operator 11) by Wagner-Fischer target alignment.

A conversation's turns are edited at least cost until their role initials read ``(s?(ua)+)?``;
``alignment`` says how.  Here is how a conversation of any length is spread out:

1. Turns are range-partitioned by (conversation, turn, role, text) and numbered within their
   conversation (``ordering``); repeats are found by one aggregate on hashes of role and text.
2. Every ``RUN`` turns of a conversation are a run, cut by the turn's number alone.  A run's turns,
   one letter each, are aligned for each pair of grammar states at its ends.
3. Runs are folded up a tree, ``FAN`` nodes at a time, and the best way is traced down again; a
   conversation of one run needs no tree.
4. Turns are sorted by conversation and streamed past their audit, which gives the repaired turns.

How runs are cut never shows in the result.  Steps 1 to 3 never bring a long conversation together.
Step 4 streams a conversation through one task, with a buffer of a few hundred turns: its audit is one
string and its SHA-256 is serial by nature.

Defined cases: null conversations are one conversation; null roles and texts are one space (so the
turn is blank); null turns come first; rows of equal turn are ordered by role, first 32 characters and
hash of the text, equal rows stand next to each other; a role without a legal initial can only be
reroled or deleted; a conversation without rows is no part of ``repaired``; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from centwise.llm import alignment as al
from centwise.llm.common import materialize, pieces, read
from centwise.llm.ordering import laid_out, numbered, spans

RUN = 32
FAN = 64
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
OFFERED = {al.START: "user", al.SYSTEM: "user", al.USER: "assistant", al.ASSISTANT: "user"}
AFTER = {"s": al.SYSTEM, "u": al.USER, "a": al.ASSISTANT}
#: Kinds of records that meet in step 4, in this order.
MARK, AUDIT, TURN = 0, 1, 2


def _stripped(text):
    return F.trim(text, F.lit(BLANKS))


def _cut_short(text):
    return ~F.substring(_stripped(text), -1, 1).isin(*ENDS)


def _batches(rows: Iterator[tuple], schema: T.StructType, most: int = 512) -> Iterator[pa.RecordBatch]:
    arrow, held = to_arrow_schema(schema), []

    def full():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield full()
            held = []
    if held:
        yield full()


def _tuples(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in pieces(batches):
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _runs(rows: Iterator[tuple], width: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first ``width`` columns."""
    held: list[tuple] = []
    for row in rows:
        if held and row[:width] != held[0][:width]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


NODE = "cid long, n long, runs long, costs array<long>, ranks array<int>"
STATE = "cid long, n long, entry int, leave int"


def _chosen(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """(cid, n, entry, leave): the states at both ends of every run on its conversation's best way."""
    node, state = T.StructType.fromDDL(NODE), T.StructType.fromDDL(STATE)

    def up(batches):
        def rows():
            for run in _runs(_tuples(batches, ["cid", "up", "runs", "costs", "ranks"]), 3):
                yield run[0][0], run[0][1], -(-run[0][2] // FAN), *al.fold([r[3:] for r in run])
        yield from _batches(rows(), node)

    def top(batches):
        yield from _batches(((c, n, al.START, al.finish(costs, ranks))
                             for c, n, costs, ranks in _tuples(batches, ["cid", "n", "costs", "ranks"])), state)

    def down(batches):
        def rows():
            for run in _runs(_tuples(batches, ["cid", "up", "n", "costs", "ranks", "entry", "leave"]), 2):
                way = al.through([r[3:5] for r in run], run[0][5], run[0][6])
                for r, a, b in zip(run, way, way[1:]):
                    yield r[0], r[2], a, b
        yield from _batches(rows(), state)

    def by_parent(df):
        return df.repartition("cid", "up").sortWithinPartitions("cid", "up", "n")

    levels = [runs.select("cid", "n", "runs", "costs", "ranks")]
    while (levels[-1].agg(F.max("runs")).first()[0] or 0) > 1:
        several = levels[-1].where("runs > 1").withColumn("up", F.floor(F.col("n") / FAN))
        levels.append(materialize(spark, by_parent(several).mapInArrow(up, NODE), "repair-tree"))
    states = levels[-1].mapInArrow(top, STATE)
    for level in reversed(levels[:-1]):
        above = states.select("cid", F.col("n").alias("up"), "entry", "leave")
        several = level.where("runs > 1").withColumn("up", F.floor(F.col("n") / FAN)).join(above, ["cid", "up"])
        states = by_parent(several).mapInArrow(down, STATE).unionByName(level.where("runs = 1").mapInArrow(top, STATE))
    return states


def _laid(turns: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        text.alias("text"))
    rows = (rows.withColumn("head", F.substring("text", 1, 32)).withColumn("h1", F.xxhash64("role", "text"))
            .withColumn("h2", F.xxhash64(F.lit("second"), "text", "role")).withColumn("own", F.monotonically_increasing_id())
            .withColumn("blank", _stripped(F.col("text")) == "").withColumn("truncated", _cut_short(F.col("text"))))
    return laid_out(rows, "conv_id", [F.col("turn").asc_nulls_first(), "role", "head", "h1", "own"], "repair-turns")


def _aligned(laid: DataFrame, run: int) -> DataFrame:
    """(conv_id, cid, n, audit): the audit of every run ``n`` of every conversation, ``d`` for a turn that had to go."""
    spark = laid.sparkSession
    known = materialize(spark, spans(laid, "conv_id"), "repair-spans")
    initial = F.lower(F.substring("role", 1, 1))
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("truncated"), F.upper(letter)).otherwise(letter)
    live = (numbered(laid.where(~F.col("blank")).select("conv_id", "seq", "h1", "h2", letter.alias("letter")), known, "conv_id")
            .groupBy("cid", "h1", "h2").agg(F.min(F.struct("n", "letter")).alias("first"))
            .select("cid", F.floor(F.col("first.n") / run).alias("n"),
                    F.struct((F.col("first.n") % run).cast("int").alias("at"), F.col("first.letter").alias("letter")).alias("turn")))
    heads = known.where(F.col("first") == F.col("cid")).select("conv_id", "cid", "total", F.ceil(F.col("total") / run).alias("runs"))
    every = (heads.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
             .withColumn("size", F.least(F.lit(run), F.col("total") - F.col("n") * run).cast("int")))
    shape = F.struct("conv_id", "size", "runs")
    letters = (every.select("cid", "n", shape.alias("shape"), F.lit(None).cast("struct<at: int, letter: string>").alias("turn"))
               .unionByName(live.withColumn("shape", F.lit(None).cast(every.select(shape.alias("s")).schema["s"].dataType)))
               .groupBy("cid", "n").agg(F.max("shape").alias("shape"), F.collect_list("turn").alias("turns"))
               .select("cid", "n", "shape.conv_id", "shape.size", "shape.runs", F.col("turns.at").alias("at"),
                       F.col("turns.letter").alias("letter")))
    out = T.StructType([*T.StructType.fromDDL(NODE).fields, letters.schema["conv_id"],
                        *T.StructType.fromDDL("audits array<string>").fields])

    def measure(batches):
        def rows():
            for cid, n, conv, size, runs, at, letter in _tuples(batches, ["cid", "n", "conv_id", "size", "runs", "at", "letter"]):
                symbols = ["-"] * size
                for i, x in zip(at, letter):
                    symbols[i] = x
                costs, ranks, audits = al.measure("".join(symbols))
                yield cid, n, runs, costs, ranks, conv, [al.marked(symbols, a) for a in audits]
        yield from _batches(rows(), out)

    runs = materialize(spark, letters.mapInArrow(measure, out), "repair-runs")
    audit = F.get("audits", F.col("entry") * al.N + F.col("leave"))
    tail = F.when(F.col("n") < F.col("runs") - 1, "").otherwise(
        F.get(F.array(*[F.lit(al.TAIL[e][1]) for e in range(al.N)]), F.col("leave")))
    return (runs.select("cid", "n", "runs", "conv_id", "audits").join(_chosen(spark, runs), ["cid", "n"])
            .select("conv_id", "cid", "n", F.concat(audit, tail).alias("audit")))


EDITED = "conv_id long, step long, edit string, role string, text string, turn long, was string, fault string"


def _edits(records: Iterator[tuple]) -> Iterator[tuple]:
    """EDITED rows from records (conv_id, kind, at, audit, turn, role, text, blank, truncated) in order."""
    for_conv, audit, p, state, step, seen = None, [], 0, al.START, 0, False

    def inserts(p, state, step):
        while p < len(audit) and audit[p] == "I":
            role = OFFERED[state]
            yield for_conv, step, "I", role, "", None, None, ""
            p, state, step = p + 1, AFTER[role[0]], step + 1

    def rest():
        yield from inserts(p, state, step)

    for conv, kind, _, part, turn, role, text, blank, truncated in records:
        if not seen or conv != for_conv:
            yield from rest()
            for_conv, parts, audit, p, state, step, seen = conv, [], "", 0, al.START, 0, True
        if kind == MARK:
            yield conv, -1, "", None, None, None, None, ""
            continue
        if kind == AUDIT:
            parts.append(part)
            continue
        if parts:
            audit, parts = "".join(parts), []
        for row in inserts(p, state, step):
            yield row
            p, state, step = p + 1, AFTER[row[3][0]], step + 1
        edit = audit[p].upper()
        now = OFFERED[state] if edit == "R" else role
        # a turn that must go and is not blank repeats an earlier one
        fault = "blank" if blank else "duplicate" if audit[p] == "d" else "truncated" if truncated else ""
        yield conv, step, edit, now, text, turn, role, fault
        p, step = p + 1, step + 1
        if edit != "D":
            state = AFTER[now[0]]
    yield from rest()


RECORD = ["conv_id", "kind", "at", "audit", "turn", "role", "text", "blank", "truncated"]


def _records(turns: DataFrame, marks: DataFrame | None, run: int) -> DataFrame:
    laid = _laid(turns)
    null = F.lit(None)
    text_cols = {"turn": null.cast("long"), "role": null.cast("string"), "text": null.cast("string"),
                 "blank": null.cast("boolean"), "truncated": null.cast("boolean")}
    live = laid.select("conv_id", F.lit(TURN).alias("kind"), F.col("seq").alias("at"), null.cast("string").alias("audit"),
                       "turn", "role", "text", "blank", "truncated")
    audits = _aligned(laid, run).select("conv_id", F.lit(AUDIT).alias("kind"), F.col("n").alias("at"), "audit").withColumns(text_cols)
    out = live.unionByName(audits)
    if marks is not None:
        out = out.unionByName(marks.select("conv_id").distinct().select(
            "conv_id", F.lit(MARK).alias("kind"), F.lit(0).cast("long").alias("at"), null.cast("string").alias("audit"))
            .withColumns(text_cols))
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at").select(*RECORD)


def _with_id(ddl: str, turns: DataFrame) -> T.StructType:
    """The schema of ``ddl`` with the input's type of conv_id."""
    return T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL(ddl).fields[1:]])


def edited(turns: DataFrame, run: int = RUN) -> DataFrame:
    """Every edit of every conversation in order: (conv_id, step, edit, role, text, turn, was, fault).
    ``edit`` is K, R, D or I; ``role`` the role after it, ``was`` the one before; inserts have no turn."""
    out = _with_id(EDITED, turns)

    def work(batches):
        yield from _batches(_edits(_tuples(batches, RECORD)), out)

    return _records(turns, None, run).mapInArrow(work, out)


def repaired(turns: DataFrame, run: int = RUN) -> DataFrame:
    """The repaired conversations: (conv_id, position, role, text), positions in order from 0 with
    gaps where a turn went."""
    return (edited(turns, run).where(F.col("edit") != "D")
            .select("conv_id", F.col("step").alias("position"), "role", "text"))


AUDITED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def _audits(edits: Iterator[tuple]) -> Iterator[tuple]:
    """AUDITED rows from the EDITED rows, one conversation after the other."""

    def closed():
        gaps = last - first + 1 - turns if turns else 0
        return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(audit), digest.hexdigest())

    conv, open_ = None, False
    for c, _, edit, role, text, turn, was, fault in edits:
        if not open_ or c != conv:
            if open_:
                yield closed()
            conv, open_, digest, lines, audit, cost, illegal = c, True, hashlib.sha256(), 0, [], 0, 0
            counts, turns, first, last, before = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, None, None
        if not edit:
            continue
        audit.append(edit)
        cost += {"K": al.KEEP, "R": al.REROLE, "D": al.DELETE, "I": al.INSERT}[edit]
        if edit != "D":
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
            cost += al.TRUNCATED * (fault == "truncated")
        if edit == "I":
            continue
        if fault:
            counts[fault] += 1
        if before is not None:
            illegal += before[:1] + was[:1] not in ("su", "ua", "au")
        before = was
        if turn is not None and turn != last:
            turns, first, last = turns + 1, turn if first is None else first, turn
    if open_:
        yield closed()


def audited(turns: DataFrame, every: DataFrame | None = None, run: int = RUN) -> DataFrame:
    """A row per conversation: faults found, cost, audit (the edits' initials in order) and the SHA-256 of
    the repaired turns.  Conversations of ``every`` (conv_id) without a turn get zeros."""
    out = _with_id(AUDITED, turns)

    def work(batches):
        yield from _batches(_audits(_edits(_tuples(batches, RECORD))), out)

    return _records(turns, every, run).mapInArrow(work, out)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage by crc32(conv_id:turn) % 20."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return (turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("kind"))
            .where("kind != 0")
            .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("kind", "copy"))


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return audited(damaged(turns), turns)
