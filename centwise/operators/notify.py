"""Notifications (OUT1, OUT2) and the report e-mail cool-down (OUT3).

Delivery (SMTP) is not built: the output is an outbox table a sender reads.

The cool-down is a greedy fold (accept a request when at least C seconds have
passed since that user's last *accepted* one), which no window expresses.
It runs in skew-safe steps so one very busy user never lands whole in one task.
A stretch of time is a map from the block time with which it is entered to the
one with which it is left: constant from one possible first accepted request to
the next.  Only the first C seconds of a stretch can depend on what came
before, so the map has a piece for each request time in them, and one more, however
long the stretch is.

1. per (user, hour), all hours of a chunk at once: requests that no earlier hour can reach are
   decided; the map, by pointer jumping, of each hour that others reach or that reaches the next;
2. per (user, 256 hours), then per (user, 65,536 hours): the maps of
   the parts composed, with their pieces cut back to the first C seconds;
3. per user: fold the few maps that are left (seven years each), then down the
   same tree: the block time entering each part;
4. per (user, hour) again, for the requests not decided yet: mark accepted / rejected and the
   remaining seconds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centwise.functions.columns import fmt
from centwise.schema import REPORT_COOLDOWN_SECONDS
from centwise.session import materialize

US = 1_000_000
SEGMENT_SECONDS = 3600
FAN_BITS = 8                                   # FAN = 256 parts make one of the next level
NO_BLOCK = -(1 << 62)
ENTRY = -(1 << 62)                             # in place of a part's number: the row that says how its parent is entered


def alert_outbox(new_events: DataFrame, users: DataFrame) -> DataFrame:
    """OUT1: one message per newly created crossing, for users with an e-mail.
    ``new_events`` is ``budgets.new_crossings`` output (rank 1 = top event)."""
    u = users.select(F.col("id").alias("user_id"), "name", "email").filter(
        F.col("email").isNotNull() & (F.trim("email") != ""))
    e = new_events.join(u, "user_id")
    # Subject and body layout of a budget alert.
    subject = F.concat(F.lit("Budget Alert: "), F.col("threshold_percent").cast("string"),
                       F.lit("% crossed for "), F.col("category"))
    body = F.concat(
        F.lit("Hi "), F.coalesce(F.col("name"), F.lit("User")), F.lit(",\n\n"), F.col("message"), F.lit("\n"),
        F.lit("Month: "), F.col("month"), F.lit("\n"), F.lit("Category: "), F.col("category"), F.lit("\n"),
        F.lit("Spent: Rs. "), fmt("spent", 2), F.lit("\n"), F.lit("Budget: Rs. "), fmt("budget", 2), F.lit("\n"),
        F.lit("Usage: "), fmt("usage_percent", 1), F.lit("%\n\n"),
        F.lit("Please review your budget settings and recent transactions.\n"))
    return e.select(
        "user_id", "email", "category", "month", "threshold_percent", subject.alias("subject"), body.alias("body"),
        F.when(F.col("threshold_percent") >= 100, F.lit("danger")).otherwise(F.lit("warning")).alias("severity"),
        (F.col("rank") == 1).alias("is_top"))


# ---- OUT3 -------------------------------------------------------------------------

def _complete_groups(batches, keys):
    """Sorted Arrow batches -> chunks holding only whole groups (a group cut by
    a batch boundary is carried into the next chunk)."""
    carry = None
    for pdf in batches:
        if carry is not None and len(carry):
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = np.ones(len(pdf), dtype=bool)
        for k in keys:
            col = pdf[k].to_numpy()
            last &= col == col[-1]
        carry = pdf[last]
        if (~last).any():
            yield pdf[~last].reset_index(drop=True)
    if carry is not None and len(carry):
        yield carry.reset_index(drop=True)


def _group_edges(pdf: pd.DataFrame, keys) -> tuple[np.ndarray, np.ndarray]:
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for k in keys:
        col = pdf[k].to_numpy()
        change[1:] |= col[1:] != col[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], len(pdf))


def _group_bounds(pdf: pd.DataFrame, keys) -> list[tuple[int, int]]:
    starts, ends = _group_edges(pdf, keys)
    return list(zip(starts.tolist(), ends.tolist()))


def _settle(cooldown_us: int, span_us: int):
    """Stage 1: each request whose fate no earlier segment can change is decided; the others, at a
    segment's beginning, are ``open``.  Where a later segment may depend on this one, ``exit_block`` is
    set at the candidates for its first accepted request: the block time each one's chain leaves it with."""
    def fn(batches):
        for pdf in _complete_groups(batches, ["user_id", "seg"]):
            if pdf["t"].hasnans:
                raise ValueError("a request has no time")
            t, seg = pdf["t"].to_numpy(np.int64), pdf["seg"].to_numpy(np.int64)
            starts, ends = _group_edges(pdf, ["user_id", "seg"])
            n, rows, group = len(t), np.arange(len(t)), np.repeat(np.arange(len(starts)), ends - starts)
            start, end, since = starts[group], ends[group], t - seg * span_us
            spread = group * (span_us + cooldown_us + 1) + since           # times of all segments, one after the other
            after = np.maximum(np.searchsorted(spread, spread + cooldown_us, side="left"), rows + 1)
            free = np.append(True, t[1:] - t[:-1] >= cooldown_us)          # accepted whatever came before
            free[starts] = since[starts] >= cooldown_us
            accepted, chain = free.copy(), np.flatnonzero(free)
            while len(chain):                                              # all chains of the chunk one step on
                then = after[chain]
                chain = then[then < end[chain]]
                chain = chain[~accepted[chain]]
                accepted[chain] = True
            last = np.maximum.accumulate(np.where(accepted, rows, -1))
            is_open = last < start
            left = np.where(accepted | is_open, 0, np.maximum(1, (cooldown_us - (t - t[last])) // US))
            leave = np.where(after < end, after, rows)
            while True:  # pointer jumping: the last accepted request of each chain
                jumped = leave[leave]
                if np.array_equal(jumped, leave):
                    break
                leave = jumped
            exits = t[leave] + cooldown_us
            matters = is_open[starts] | (exits[starts] > (seg[starts] + 1) * span_us)
            new = rows == start
            early = np.append(True, since[:-1] < cooldown_us) | new
            cand = matters[group] & early & (new | np.append(True, t[1:] != t[:-1]))
            yield pd.DataFrame({"request_id": pdf["request_id"].to_numpy(np.int64), "user_id": pdf["user_id"].to_numpy(np.int64),
                                "seg": seg, "t": t, "open": is_open, "accepted": accepted, "remaining_seconds": left,
                                "exit_block": np.where(cand, exits, NO_BLOCK)})
    return fn


def _compose(first, then, start: int, cooldown_us: int):
    """The map of two consecutive stretches as (request times, block times they lead to), cut back to
    the entries that a stretch beginning at ``start`` can have."""
    (ct, ex), (ct2, ex2) = first, then
    j = np.searchsorted(ct2, ex, side="left")
    through = np.where(j < len(ct2), ex2[np.minimum(j, len(ct2) - 1)], ex)
    beyond = int(np.searchsorted(ct2, ct[-1], side="right"))
    ct, ex = np.append(ct, ct2[beyond:]), np.append(through, ex2[beyond:])
    keep = int(np.searchsorted(ct, start + cooldown_us, side="left")) + 1
    return ct[:keep], ex[:keep]


def _maps(pdf: pd.DataFrame, part: str):
    """(user, parent, [(part, map), ...]) for the groups of a chunk sorted by user, parent, part, time."""
    t, ex, parts = pdf["cand_t"].to_numpy(np.int64), pdf["exit_block"].to_numpy(np.int64), pdf[part].to_numpy(np.int64)
    for a, b in _group_bounds(pdf, ["user_id", "up"]):
        own = [(a + x, a + y) for x, y in _group_bounds(pdf.iloc[a:b], [part])]
        yield int(pdf["user_id"].iat[a]), int(pdf["up"].iat[a]), [(int(parts[x]), (t[x:y], ex[x:y])) for x, y in own]


def _fold_up(cooldown_us: int, span_us: int):
    """Step 2: the map of each parent from its parts' maps; a part is ``span_us`` long."""
    def fn(batches):
        for pdf in _complete_groups(batches, ["user_id", "up"]):
            out = []
            for user, up, parts in _maps(pdf, "seg"):
                start, whole = parts[0][0] * span_us, parts[0][1]
                for _, then in parts[1:]:
                    whole = _compose(whole, then, start, cooldown_us)
                out.append(pd.DataFrame({"user_id": user, "seg": up, "cand_t": whole[0], "exit_block": whole[1]}))
            yield pd.concat(out)
    return fn


def _enter(top: bool):
    """Step 3: the block time entering each part, from the parent's, which comes before the parts as
    the row ENTRY (no block where ``top``)."""
    def fn(batches):
        for pdf in _complete_groups(batches, ["user_id", "up"]):
            users, segs, blocks = [], [], []
            for user, up, parts in _maps(pdf, "seg"):
                block = NO_BLOCK if top else int(parts.pop(0)[1][1][0])
                for part, (ct, ex) in parts:
                    users.append(user)
                    segs.append(part)
                    blocks.append(block)
                    j = int(np.searchsorted(ct, block, side="left"))
                    block = int(ex[j]) if j < len(ct) else block
            yield pd.DataFrame({"user_id": users, "seg": segs, "entry_block": blocks})
    return fn


def _entries(maps: DataFrame, cooldown_us: int, span_us: int) -> DataFrame:
    """(user_id, seg, entry_block) of every segment that has a map."""
    def by_parent(df, shift):
        up = F.shiftright("seg", shift) if shift else F.lit(0).cast("long")
        return (df.withColumn("up", up).repartition("user_id", "up").sortWithinPartitions("user_id", "up", "seg", "cand_t"))

    row, found = "user_id long, seg long, cand_t long, exit_block long", "user_id long, seg long, entry_block long"
    levels = [materialize(maps.sparkSession, maps, "throttle_maps")]
    for level in range(2):
        span = span_us << (FAN_BITS * level)
        levels.append(materialize(maps.sparkSession, by_parent(levels[-1], FAN_BITS).mapInPandas(_fold_up(cooldown_us, span), row),
                                  "throttle_maps"))
    entry = by_parent(levels.pop(), 0).mapInPandas(_enter(True), found)
    for below in reversed(levels):
        e = entry.select("user_id", F.lit(ENTRY).alias("seg"), F.lit(0).cast("long").alias("cand_t"), F.col("entry_block").alias("exit_block"),
                         F.col("seg").alias("up"))
        both = below.withColumn("up", F.shiftright("seg", FAN_BITS)).unionByName(e)    # see _mark on why no join
        entry = (both.repartition("user_id", "up").sortWithinPartitions("user_id", "up", "seg", "cand_t")
                 .mapInPandas(_enter(False), found))
    return entry


def _mark(cooldown_us: int):
    """Stage 3: the greedy pass inside each segment from its entry block, jumping from one
    accepted request to the next by binary search.

    The entry is each segment's first row.  It is not joined to the others: Spark drops a repartition
    by the keys of the join below it, and may then make that join a broadcast that reads its other
    side as it was written, so that a segment's rows come to several tasks."""
    def fn(batches):
        key, last = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            t_all = pdf["t"].to_numpy(np.int64)
            acc = np.zeros(len(pdf), dtype=bool)
            rem = np.zeros(len(pdf), dtype=np.int64)
            for a, b in _group_bounds(pdf, ["user_id", "seg"]):
                k = (int(pdf["user_id"].iat[a]), int(pdf["seg"].iat[a]))
                if k != key:                       # else the segment goes on from the last batch
                    key, entry = k, int(t_all[a])
                    last = None if entry == NO_BLOCK else entry - cooldown_us
                    a += 1
                t, i = t_all[a:b], 0
                while i < len(t):
                    j = 0 if last is None else max(i, int(np.searchsorted(t, last + cooldown_us, side="left")))
                    if j > i:
                        rem[a + i:a + j] = np.maximum(1, (cooldown_us - (t[i:j] - last)) // US)
                    if j < len(t):
                        acc[a + j], last = True, int(t[j])
                    i = j + 1
            out = pd.DataFrame({"request_id": pdf["request_id"].to_numpy(np.int64),
                                "user_id": pdf["user_id"].to_numpy(np.int64),
                                "accepted": acc, "remaining_seconds": rem})
            yield out[~pdf["is_entry"].to_numpy(bool)]
    return fn


def throttle_requests(requests: DataFrame, cooldown_seconds: int = REPORT_COOLDOWN_SECONDS) -> DataFrame:
    """OUT3 over (request_id, user_id, t) with ``t`` in microseconds.

    Returns request_id, user_id, accepted, remaining_seconds (0 when accepted,
    else whole seconds left, at least 1).  A request that follows its user's last one by the
    cool-down or more is accepted whatever came before, so most are decided in the one pass over
    all requests; only those that an earlier segment can reach go through the tree and are marked
    after it.  What a task holds at once is one user's requests of one segment.
    """
    c = int(cooldown_seconds) * US
    span = max(SEGMENT_SECONDS * US, c)                # a segment reaches into the next one only
    r = requests.where(F.col("user_id").isNotNull()).select("request_id", "user_id", F.col("t").cast("long").alias("t")).withColumn(
        "seg", F.expr(f"(t - pmod(t, {span}L)) div {span}L"))
    by_seg = r.repartition("user_id", "seg").sortWithinPartitions("user_id", "seg", "t", "request_id")
    settled = materialize(r.sparkSession, by_seg.mapInPandas(
        _settle(c, span), "request_id long, user_id long, seg long, t long, open boolean, accepted boolean, "
                          "remaining_seconds long, exit_block long"), "throttle_settled")
    maps = settled.where(F.col("exit_block") != NO_BLOCK).select("user_id", "seg", F.col("t").alias("cand_t"), "exit_block")
    entries = _entries(maps, c, span).select(F.lit(0).cast("long").alias("request_id"), "user_id", "seg", F.col("entry_block").alias("t"),
                                             F.lit(True).alias("is_entry"))
    j = settled.where("open").select("request_id", "user_id", "seg", "t", F.lit(False).alias("is_entry")).unionByName(entries)
    j = j.repartition("user_id", "seg").sortWithinPartitions("user_id", "seg", F.col("is_entry").desc(), "t", "request_id")
    out = "request_id long, user_id long, accepted boolean, remaining_seconds long"
    return settled.where("NOT open").select("request_id", "user_id", "accepted", "remaining_seconds").unionByName(
        j.mapInPandas(_mark(c), out))
