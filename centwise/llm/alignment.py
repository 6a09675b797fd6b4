"""Least edits that turn a run of conversation turns into a legal role string (operator 11's core).

The grammar is ``(s?(ua)+)?`` over role initials.  A run of turns is a string of symbols, one per
turn: ``-`` for a turn that must go (blank or a repeat), else the role's initial ``s``, ``u``, ``a``
or ``o`` (any other), in capitals if the turn is truncated.

Wagner-Fischer target alignment.  Between two states of the grammar the legal strings are one
alternating string for each length (``uaua..``, ``auau..``, ``suau..``).  The run is aligned with
every length that can still win: keep 0 or rerole 3 on the diagonal, delete 4, insert 3, and 3 for a
truncated turn that stays.  The cheapest alignment so far (the incumbent) bounds both the lengths,
since each step off the diagonal costs something, and each alignment's Ukkonen band.  Equally cheap
alignments are traced back greedily to their least audit (the edits' initials), and audits of equal
cost are compared across the lengths.

Inserts stand before a turn's own edit, so a run's audit ends with its last turn's edit.  No audit of
a run is then a prefix of another one of the same run, and runs put together compare run by run.
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
N = 4
INF = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# What completes a conversation that ends in a state: its cost and audit.
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def target(family: str, length: int) -> str:
    """The legal string of a family ('u', 'a' or 's' first) and length."""
    if family == "s":
        return ("s" + "ua" * (length // 2 + 1))[:length]
    return (("ua" if family == "u" else "au") * (length // 2 + 1))[:length]


class Run:
    """One run of turns with the costs of its edits over the unavoidable ones."""

    def __init__(self, symbols: str) -> None:
        self.symbols = symbols
        self.live = [x != "-" for x in symbols]
        self.upto = [0]
        for x in self.live:
            self.upto.append(self.upto[-1] + x)
        self.m = self.upto[-1]
        cut = sum(x in "SUAO" for x in symbols)
        # a truncated turn costs 3 anyway, so deleting it costs 1 more; the rest costs 4
        self.base = DELETE * (len(symbols) - self.m) + TRUNCATED * cut
        self.drops = [DELETE - TRUNCATED] * cut + [DELETE] * (self.m - cut)
        self.least_drop = self.drops[0] if self.drops else DELETE
        self.delete = [DELETE - TRUNCATED if x in "SUAO" else DELETE for x in symbols]
        self.initial = symbols.lower()

    def bound(self, length: int) -> int:
        """No alignment with a target of this length costs less."""
        over = length - self.m
        return INSERT * over if over >= 0 else sum(self.drops[:-over])

    def off(self, a: int, b: int) -> int:
        """The least cost from diagonal a to b."""
        return INSERT * (b - a) if b >= a else self.least_drop * (a - b)

    def align(self, goal: str, limit: int) -> tuple[int, str] | None:
        """(cost, least audit) of the alignment with ``goal`` if it costs ``limit`` at most."""
        end, length, n = len(goal) - self.m, len(goal), len(self.symbols)
        low = high = 0
        while self.off(0, low - 1) + self.off(low - 1, end) <= limit and low > -self.m:
            low -= 1
        while self.off(0, high + 1) + self.off(high + 1, end) <= limit and high < length:
            high += 1
        low, high = min(low, end), max(high, end)
        width = high - low + 1
        table = [[INF] * (width + 1) for _ in range(n + 1)]                     # one column more: never reached
        table[n][end - low] = 0
        initial, live, upto, delete = self.initial, self.live, self.upto, self.delete
        for i in range(n - 1, -1, -1):
            row, below, stays = table[i], table[i + 1], live[i]
            for c in range(width - 1, -1, -1):
                j = upto[i] + low + c
                if j < 0 or j > length:
                    continue
                if stays:
                    best = below[c - 1] + delete[i] if c else INF
                    if j < length:
                        g = goal[j]
                        cost = KEEP if g == initial[i] else INF if g == "s" else REROLE
                        best = min(best, below[c] + cost)
                else:
                    best = below[c]
                if j < length and goal[j] != "s":
                    best = min(best, row[c + 1] + INSERT)
                row[c] = best
        cost = table[0][-low]
        if cost > limit:
            return None
        i, c, audit = 0, -low, []
        while i < n:                                       # the least letter first: D, I, K, R
            row, below, j = table[i], table[i + 1], upto[i] + low + c
            if not live[i]:
                if row[c] == below[c]:
                    audit.append("D")
                    i += 1
                    continue
            elif c and row[c] == below[c - 1] + delete[i]:
                audit.append("D")
                i, c = i + 1, c - 1
                continue
            if goal[j:j + 1] != "s" and j < length and row[c] == row[c + 1] + INSERT:
                audit.append("I")
                c += 1
                continue
            audit.append("K" if goal[j] == initial[i] else "R")
            i += 1
        return cost, "".join(audit)

    def cheapest(self, family: str, first: int, step: int) -> tuple[int, str] | None:
        """(cost, least audit) over the lengths first, first + step, ... of a family."""
        # a system turn must be there, and a turn after it if the string goes on: nothing is inserted at the end
        if family == "s" and "s" not in (self.initial[:-1] if first > 1 else self.initial):
            return None
        near = first if not step or self.m <= first else first + (self.m - first) // step * step
        limit, best = max(6, self.bound(near)), None
        while best is None:                                # the first incumbent, by doubling its band
            best = self.align(target(family, near), limit)
            limit *= 2
        if not step:
            return best
        for way in (step, -step):
            length = near + way
            while length >= first and self.bound(length) <= best[0]:
                best = min(best, self.align(target(family, length), best[0]) or best)
                length += way
        return best


#: Entry state, family, shortest length, step between lengths, exit state.
PATHS = [
    (START, "u", 0, 0, START), (START, "u", 1, 2, USER), (START, "u", 2, 2, ASSISTANT),
    (START, "s", 1, 0, SYSTEM), (START, "s", 2, 2, USER), (START, "s", 3, 2, ASSISTANT),
    (SYSTEM, "u", 0, 0, SYSTEM), (SYSTEM, "u", 1, 2, USER), (SYSTEM, "u", 2, 2, ASSISTANT),
    (ASSISTANT, "u", 1, 2, USER), (ASSISTANT, "u", 0, 2, ASSISTANT),
    (USER, "a", 1, 2, ASSISTANT), (USER, "a", 0, 2, USER),
]


@lru_cache(maxsize=20_000)
def measure(symbols: str) -> tuple[tuple[int, ...], tuple[int, ...], tuple[str, ...]]:
    """(costs, ranks, audits) of a run, 16 each: at ``entry * 4 + leave`` the least cost between the
    two states, that audit's place among the audits from ``entry``, and the audit."""
    run, memo = Run(symbols), {}
    costs, audits = [INF] * (N * N), [""] * (N * N)
    for entry, family, first, step, leave in PATHS:
        if (key := (family, first, step)) not in memo:
            memo[key] = run.cheapest(family, first, step)
        if memo[key] is None:
            continue
        found, at = (memo[key][0] + run.base, memo[key][1]), entry * N + leave
        if costs[at] == INF or found < (costs[at], audits[at]):
            costs[at], audits[at] = found
    ranks = [0] * (N * N)
    for entry in range(N):
        reached = [at for at in range(entry * N, entry * N + N) if costs[at] < INF]
        for rank, at in enumerate(sorted(reached, key=audits.__getitem__)):
            ranks[at] = rank
    return tuple(costs), tuple(ranks), tuple(audits)


def marked(symbols: str, audit: str) -> str:
    """The audit of a run with ``d`` where a turn had to go."""
    turns, out = iter(symbols), []
    for x in audit:
        out.append(x.lower() if x != "I" and next(turns) == "-" else x)
    return "".join(out)


# ---- runs put together ---------------------------------------------------------------------------


def _joined(costs, ranks, more, more_ranks):
    """The composition of two nodes, and for each pair of states the state between them."""
    out, order, middle = [INF] * (N * N), [0] * (N * N), [0] * (N * N)
    for a in range(N):
        keys = {}
        for b in range(N):
            ways = [(costs[a * N + m] + more[m * N + b], ranks[a * N + m], m) for m in range(N)
                    if costs[a * N + m] < INF and more[m * N + b] < INF]
            if ways:
                cost, rank, m = min(ways)
                out[a * N + b], middle[a * N + b] = cost, m
                keys[a * N + b] = (rank, more_ranks[m * N + b])
        for rank, at in enumerate(sorted(keys, key=keys.__getitem__)):
            order[at] = rank
    return out, order, middle


def fold(nodes: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """(costs, ranks) of consecutive nodes together."""
    costs, ranks = nodes[0]
    for more, more_ranks in nodes[1:]:
        costs, ranks, _ = _joined(costs, ranks, more, more_ranks)
    return costs, ranks


def through(nodes: list[tuple[list[int], list[int]]], entry: int, leave: int) -> list[int]:
    """The states between consecutive nodes on the best way from ``entry`` to ``leave``."""
    (costs, ranks), middles = nodes[0], []
    for more, more_ranks in nodes[1:]:
        costs, ranks, middle = _joined(costs, ranks, more, more_ranks)
        middles.append(middle)
    way = [leave]
    for middle in reversed(middles):
        way.append(middle[entry * N + way[-1]])
    return [entry, *reversed(way)]


def finish(costs, ranks) -> int:
    """The state in which a whole conversation best ends."""
    return min((costs[e] + TAIL[e][0], ranks[e], e) for e in range(N) if costs[e] < INF)[2]
