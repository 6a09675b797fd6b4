"""Chat formatting with minimum-cost role repair (operator 3).

A legal conversation is an optional system turn, then user and assistant turns by turns, the user
first.  The automaton's states are the role that spoke last: start, system, user, assistant.
Every given turn is kept, merged into the turn before it, relabelled, or preceded by an inserted
empty turn; dynamic programming over the states finds the cheapest sequence of such choices, and
the repaired sequence is rendered.

Costs (parameters): MERGE, RELABEL, INSERT; a merge of another role pays for the relabel too.  A
role that is null or unknown costs UNKNOWN whichever legal role it takes.  Ties go to the first of
keep, merge, insert, relabel.

Long conversations: turns are range-partitioned by (conversation, turn, role, text) and numbered
within their conversation (``ordering``); every ``SEGMENT`` turns by that number are a segment, however
the rows are partitioned.  A segment becomes a 4 x 4 matrix of least costs; matrices multiply (min, +)
up a tree of ``SEGMENT`` children a node, and the chosen states come down the same tree, after which
each segment renders its own turns.  No task ever holds a conversation.  A conversation of up to
``SEGMENT`` turns is one row; the rendered parts of longer ones follow each other by ``part``.

Defined cases: turns are ordered by turn, role, the first 32 characters and then a hash of the text,
nulls first; null and empty texts are empty turns; repeated rows are turns of their own and get merged; a null conv_id is a conversation of its
own; ``<|`` in a text is written ``<\\u200b|`` so that no text can close or open a turn; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centwise.llm.common import materialize, read
from centwise.llm.ordering import laid_out, numbered, spans

SEGMENT = 512
MERGE, RELABEL, INSERT, UNKNOWN = 1, 3, 2, 1
FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
# Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
           "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def role_of(name: str | None) -> int | None:
    return ALIASES.get((name or "").strip().lower())


def moves(role: int | None) -> list[tuple[int, int, int, str, int | None]]:
    """(from, to, cost, action, inserted role) for a turn of ``role``, in order of preference."""
    out = []
    rename = lambda to: UNKNOWN if role is None else 0 if to == role else RELABEL
    for state in range(4):
        for to in NEXT[state]:
            out.append((state, to, rename(to), "keep" if rename(to) == 0 else "relabel", None))
        if state != START:
            out.append((state, state, MERGE + rename(state), "merge", None))
        for between in (USER, ASSISTANT):
            if between in NEXT[state]:
                for to in NEXT[between]:
                    out.append((state, to, INSERT + rename(to), "insert", between))
    order = ("keep", "merge", "insert", "relabel")
    return sorted(out, key=lambda m: order.index(m[3]))


MOVES = {role: moves(role) for role in (None, SYSTEM, USER, ASSISTANT)}


def advance(cost: list[int], role: int | None) -> tuple[list[int], list[tuple | None]]:
    """Costs by state after a turn, and the move that led to each."""
    best, by = [FAR] * 4, [None] * 4
    for move in MOVES[role]:
        total = cost[move[0]] + move[2]
        if total < best[move[1]]:
            best[move[1]], by[move[1]] = total, move
    return best, by


def matrix(roles: list[int | None]) -> list[int]:
    """Least cost from each state to each, row by row."""
    out = []
    for state in range(4):
        cost = [0 if s == state else FAR for s in range(4)]
        for role in roles:
            cost = advance(cost, role)[0]
        out += cost
    return out


def product(mats: list[list[int]]) -> list[int]:
    out = mats[0]
    for m in mats[1:]:
        out = [min(FAR, min(out[4 * a + k] + m[4 * k + b] for k in range(4))) for a in range(4) for b in range(4)]
    return out


def through(mats: list[list[int]], entry: int, leave: int) -> list[int]:
    """The states between matrices (entry and leave included) on a cheapest way."""
    costs = [[0 if s == entry else FAR for s in range(4)]]
    for m in mats:
        costs.append([min(costs[-1][k] + m[4 * k + b] for k in range(4)) for b in range(4)])
    way = [leave]
    for m, before in zip(reversed(mats), reversed(costs[:-1])):
        way.append(min(range(4), key=lambda k: before[k] + m[4 * k + way[-1]]))
    return way[::-1]


def repair(roles: list[int | None], entry: int, leave: int) -> list[tuple]:
    """The cheapest moves from state ``entry`` to ``leave``."""
    cost, back = [0 if s == entry else FAR for s in range(4)], []
    for role in roles:
        cost, by = advance(cost, role)
        back.append(by)
    out, state = [], leave
    for by in reversed(back):
        out.append(by[state])
        state = by[state][0]
    return out[::-1]


def safe(text: str | None) -> str:
    return (text or "").replace("<|", "<\u200b|")


def rendered(chosen: list[tuple], texts: list[str | None], entry: int, last: bool) -> str:
    """The segment's share of the conversation; it closes the turn that is open when it begins."""
    out, state = [], entry
    for (_, to, _, action, between), text in zip(chosen, texts):
        if action == "merge":
            out.append(f"\n\n{safe(text)}")
            continue
        for role, words in ((between, ""), (to, safe(text))):
            if role is not None:
                out.append(("" if state == START else "<|im_end|>\n") + f"<|im_start|>{ROLES[role]}\n{words}")
                state = role
    if last and state != START:
        out.append("<|im_end|>\n")
    return "".join(out)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Neighbouring rows of equal keys, as lists."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def give(rows: Iterable[tuple], schema: T.StructType, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


def _type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _grouped(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def format_chats(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, part, n_turns, cost, n_kept, n_merged, n_inserted, n_relabelled, rendered); ``part``
    numbers the segments of a conversation and ``cost`` is that of the part."""
    spark = turns.sparkSession
    rows = (turns.select("conv_id", "turn", "role", "text").withColumn("head", F.substring("text", 1, 32))
            .withColumn("hash", F.xxhash64("text")).withColumn("own", F.monotonically_increasing_id()))
    laid = laid_out(rows, "conv_id", ["turn", "role", "head", "hash", "own"], "chat-turns")
    known = materialize(spark, spans(laid, "conv_id"), "chat-spans")
    cut = F.floor(F.col("n") / segment)
    node = _type("cid long, n long, costs array<long>")

    def measure(batches):
        yield from give(((run[0]["cid"], run[0]["cut"], matrix([role_of(r["role"]) for r in run]))
                         for run in runs(batches, ["cid", "cut"])), node)

    narrow = numbered(laid.select("conv_id", "seq", "role"), known, "conv_id").select("cid", cut.alias("cut"), "n", "role")
    base = materialize(spark, _grouped(narrow, ["cid", "cut"], "n").mapInArrow(measure, node), "chat-segments")

    def fold(batches):
        yield from give(((run[0]["cid"], run[0]["up"], product([r["costs"] for r in run]))
                         for run in runs(batches, ["cid", "up"])), node)

    levels = [base]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("up", F.floor(F.col("n") / segment))
        levels.append(materialize(spark, _grouped(up, ["cid", "up"], "n").mapInArrow(fold, node), "chat-tree"))
    ends = _type("cid long, n long, entry int, leave int")

    def finish(batches):
        yield from give(((r["cid"], r["n"], START, min(range(4), key=r["costs"][:4].__getitem__))
                         for batch in batches for r in batch.to_pylist()), ends)

    def descend(batches):
        def rows():
            for run in runs(batches, ["cid", "up"]):
                way = through([r["costs"] for r in run], run[0]["entry"], run[0]["leave"])
                for r, a, b in zip(run, way, way[1:]):
                    yield r["cid"], r["n"], a, b
        yield from give(rows(), ends)

    states = levels.pop().mapInArrow(finish, ends)
    while levels:
        above = states.select("cid", F.col("n").alias("up"), "entry", "leave")
        both = levels.pop().withColumn("up", F.floor(F.col("n") / segment)).join(above, ["cid", "up"])
        states = _grouped(both, ["cid", "up"], "n").mapInArrow(descend, ends)
    heads = known.where(F.col("first") == F.col("cid")).select("conv_id", "cid", F.ceil(F.col("total") / segment).alias("parts"))
    null = F.lit(None)
    # a segment's states come before its turns (``at`` -1): the texts meet them by one shuffle
    marks = (states.join(heads, "cid").select("conv_id", "cid", F.col("n").alias("cut"), F.lit(-1).cast("long").alias("at"), "parts", "entry", "leave")
             .withColumns({"role": null.cast("string"), "text": null.cast("string")}))
    said = (numbered(laid.select("conv_id", "seq", "role", "text"), known, "conv_id")
            .select("conv_id", "cid", cut.alias("cut"), F.col("n").alias("at"), "role", "text")
            .withColumns({"parts": null.cast("long"), "entry": null.cast("int"), "leave": null.cast("int")}))
    out = _type("conv_id long, part long, n_turns long, cost long, n_kept long, n_merged long, n_inserted long, "
                "n_relabelled long, rendered string")

    def write(batches):
        def parts():
            for mark, *run in runs(batches, ["cid", "cut"]):
                chosen = repair([role_of(r["role"]) for r in run], mark["entry"], mark["leave"])
                acts = [m[3] for m in chosen]
                yield (mark["conv_id"], mark["cut"], len(run), sum(m[2] for m in chosen), acts.count("keep"), acts.count("merge"),
                       acts.count("insert"), acts.count("relabel"),
                       rendered(chosen, [r["text"] for r in run], mark["entry"], mark["cut"] + 1 == mark["parts"]))
        yield from give(parts(), out, 200)

    return _grouped(said.unionByName(marks), ["cid", "cut"], "at").mapInArrow(write, out)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))
