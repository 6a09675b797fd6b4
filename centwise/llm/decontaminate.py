"""Benchmark decontamination (operator 9): CGK embedding, bit-sampling LSH, exact verification.

A leak is a run of words of a document within edit distance ``floor((1 - similarity) * n)`` of a
benchmark item of n words (words are ``\\w+`` of the lower-cased text; edits are of words).

1. Gate.  The q-gram lemma says that a leak with k edits keeps n - q + 1 - k * q of the item's word
   q-grams, on diagonals at most k apart.  Item-sized windows are laid only where that many grams
   meet, at the diagonals on which they lie; elsewhere no leak can be.
2. CGK embedding.  A random walk reads each window and each item of the same size into 3 n symbols,
   so that edits become Hamming differences: the walk stays or steps on by a random bit of
   (repetition, step, word), which re-aligns the two walks after an edit.
3. LSH.  Each of ``repetitions`` walks is sampled at ``SAMPLES`` of the steps before the text's end
   (padding agrees with padding and would select nothing; a walk that is early at the last word
   stays there); windows meet the items whose samples agree in some repetition.  The share of agreeing steps falls with the length, so the number
   of repetitions follows, for each item length, from the target recall and from how often ``LEAKS``
   simulated leaks at the full edit budget meet their items.
4. Verification.  The exact edit distance of the item to the best run of words around the window
   (bit-parallel, with the item's words as the bits).

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words, which the driver gathers and
broadcasts: a block's size is bounded whatever the benchmark's.  Documents are never shuffled.

Defined cases: null and empty texts hold no leak; items without words are no items; items of equal
words count as one, named by the smallest item_id (nulls last); repeated documents each get their
rows; a benchmark or document table that is empty gives no matches; extra columns pass
``decontaminate`` untouched.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centwise.llm.common import pieces, read

SIMILARITY = 0.8
RECALL = 0.99
SAMPLES = 2
LEAKS = 256
BLOCK_WORDS = 1_000_000
WORD = r"\w+"


def budget(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


@cache
def repetitions(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Repetitions for items of n words, so that the worst kind of simulated leak meets its item.
    Half of the misses that ``recall`` allows is left to the error of the estimate."""
    if not recall < 1:
        raise ValueError("recall must be below 1")
    if not (k := budget(n, similarity)):
        return 1                                           # equal words make equal walks
    items = np.arange(1, LEAKS * n + 1).reshape(LEAKS, n)
    kinds = simulated_leaks(items, k)
    reps = 16
    while True:
        own = cgk_samples(items, reps)[:, :, None]
        met = [(cgk_samples(x.reshape(-1, n), reps).reshape(reps, *x.shape[:2]) == own[:, :len(x)]).any(2).mean(1)
               for x in kinds]
        enough = np.cumprod(1 - np.array(met), axis=1).max(0) <= (1 - recall) / 2
        if enough[-1]:
            return int(enough.argmax()) + 1
        reps *= 2


def simulated_leaks(items: np.ndarray, k: int) -> list[np.ndarray]:
    """Windows [leaks, windows, n] of items of distinct words for kinds of leaks with k edits at even
    distances: words replaced, from each possible first word on, and words deleted, which lays a
    window for each deletion (at most 8 of them are simulated)."""
    count, n = items.shape
    at = np.arange(k) * n // k
    kinds = []
    for first in range(n // k):
        leaks = items.copy()
        leaks[:, at + first] += items.max()
        kinds.append(leaks[:, None])
    some = items[:count // 4]
    around = some + 2 * items.max()                        # words before and after the leak
    long = np.concatenate([around[:, :k], np.delete(some, at, axis=1), around], axis=1)
    starts = k - np.unique(np.linspace(1, k, min(k, 8)).astype(int))
    return [*kinds, np.stack([long[:, s:s + n] for s in starts], axis=1)]


def gram_size(n: int, similarity: float) -> tuple[int, int]:
    """(q, how many of an item's q-grams a leak keeps at least) for items of n words."""
    k = budget(n, similarity)
    return next((q, n - q + 1 - k * q) for q in (3, 2, 1) if n - q + 1 - k * q > 0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sampled_steps(n: int) -> int:
    """The first steps, in which a walk still reads words: it takes about 2 n steps to the text's end."""
    return max(n, 2 * n - math.ceil(4 * math.sqrt(n)))


def cgk_samples(words: np.ndarray, reps: int) -> np.ndarray:
    """LSH keys [reps, windows] of windows [windows, n] of word numbers (-1: past the text's end)."""
    count, n = words.shape
    steps = sampled_steps(n)
    rng = np.random.default_rng(n)
    sampled = np.zeros((reps, steps), bool)
    for r in range(reps):
        sampled[r, rng.choice(steps, min(SAMPLES, steps), replace=False)] = True
    words = words.astype(np.int64)
    at = np.zeros((reps, count), np.int64)
    keys = np.broadcast_to(np.arange(reps, dtype=np.uint64)[:, None], (reps, count)).copy()
    row = np.arange(count)
    salt = np.arange(reps, dtype=np.uint64)[:, None] << np.uint64(32)
    for step in range(steps):
        now = words[row, at]
        picked = sampled[:, step]
        if picked.any():
            keys[picked] = _mix(keys[picked] * np.uint64(0x9E3779B97F4A7C15) + now[picked].astype(np.uint64))
        coin = _mix((now.astype(np.uint64) + np.uint64(step << 40)) ^ salt) >> np.uint64(63)
        at = np.minimum(at + coin.astype(np.int64), n - 1)
    return _mix(keys + np.uint64(n << 32))


def infix_distance(masks: dict[int, int], n: int, words: list[int], anchored: bool = False) -> tuple[int, int]:
    """(smallest edit distance of the n-word item to a run of ``words``, where the first such run
    ends); ``anchored``: to a run from the first word on."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = (n, 0)
    for j, w in enumerate(words, 1):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best[0]:
            best = (score, j)
    return best


class Index:
    """The block's items: word numbers, gram lists, LSH keys."""

    def __init__(self, items: list[tuple[int | None, list[str]]], similarity: float, recall: float) -> None:
        self.similarity = similarity
        self.word: dict[str, int] = {}
        for _, words in items:
            for w in words:
                self.word.setdefault(w, len(self.word) + 1)
        self.ids = [i for i, _ in items]
        self.items = [[self.word[w] for w in words] for _, words in items]
        self.grams: dict[int, tuple[np.ndarray, ...]] = {}
        self.gate: list[tuple[int, int]] = [gram_size(len(x), similarity) for x in self.items]
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.reps: dict[int, int] = {}
        base = len(self.word) + 1
        by_q, by_n = defaultdict(list), defaultdict(list)
        for i, x in enumerate(self.items):
            q = self.gate[i][0]
            by_q[q] += [(self._gram(x[j:j + q], base), i, j) for j in range(len(x) - q + 1)]
            by_n[len(x)].append(i)
        for q, rows in by_q.items():
            table = np.array(sorted(rows), np.int64)
            codes, first, count = np.unique(table[:, 0], return_index=True, return_counts=True)
            self.grams[q] = (codes, first, count, table[:, 1], table[:, 2])
        for n, members in by_n.items():
            reps = self.reps[n] = repetitions(n, similarity, recall)
            keys = cgk_samples(np.array([self.items[i] for i in members]), reps)
            flat, who = keys.ravel(), np.tile(np.array(members), reps)
            order = np.argsort(flat, kind="stable")
            self.keys[n] = (flat[order], who[order])

    @staticmethod
    def _gram(words: list[int], base: int) -> int:
        code = 0
        for w in words:
            code = code * base + w
        return code

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, positions, diagonals) of the items with enough grams in the document."""
        base = len(self.word) + 1
        for q, (codes, first, count, who, offset) in self.grams.items():
            m = len(numbers) - q + 1
            if m <= 0:
                continue
            grams, known = np.zeros(m, np.int64), np.ones(m, bool)
            for j in range(q):
                part = numbers[j:j + m]
                grams = grams * base + part
                known &= part > 0
            at = np.flatnonzero(known)
            slot = np.minimum(np.searchsorted(codes, grams[at]), len(codes) - 1)
            found = codes[slot] == grams[at]
            at, slot = at[found], slot[found]
            if not len(at):
                continue
            reps = count[slot]
            inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            entry = np.repeat(first[slot], reps) + inner
            items, places = who[entry], np.repeat(at, reps)
            diagonals = places - offset[entry]
            order = np.lexsort((diagonals, items))
            items, places, diagonals = items[order], places[order], diagonals[order]
            cuts = np.flatnonzero(np.diff(items)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(items)]])):
                if hi - lo >= self.gate[items[lo]][1]:
                    yield int(items[lo]), places[lo:hi], diagonals[lo:hi]

    def windows(self, numbers: np.ndarray) -> dict[int, set[int]]:
        """Window starts by window size, where the gate leaves room for a leak."""
        out: dict[int, set[int]] = defaultdict(set)
        for item, _, diagonals in self.hits(numbers):
            n = len(self.items[item])
            k, least = budget(n, self.similarity), self.gate[item][1]
            starts = np.unique(diagonals)
            near = np.searchsorted(diagonals, starts + k, "right") - np.searchsorted(diagonals, starts - k, "left")
            out[n].update(np.maximum(starts[near >= least], 0).tolist())
        return out

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, words) for each leaked item, best run each."""
        split, number = re.compile(WORD).findall, self.word.get
        laid: dict[int, list[tuple[int, int]]] = defaultdict(list)
        docs: dict[int, np.ndarray] = {}
        for t, text in enumerate(texts):
            words = split(text.lower())
            numbers = np.fromiter(map(number, words, repeat(0)), np.int64, len(words))
            for n, starts in self.windows(numbers).items():
                docs[t] = numbers
                laid[n] += [(t, s) for s in starts]
        regions: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, places in laid.items():
            keys, who = self.keys[n]
            for part in (places[i:i + 2000] for i in range(0, len(places), 2000)):
                grid = np.full((len(part), n), -1, np.int64)
                for row, (t, s) in enumerate(part):
                    run = docs[t][s:s + n]
                    grid[row, :len(run)] = run
                found = cgk_samples(grid, self.reps[n])
                lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
                for r, row in zip(*np.nonzero(hi > lo)):
                    for item in set(who[lo[r, row]:hi[r, row]].tolist()):
                        regions[part[row][0], item].append(part[row][1])
        for (t, item), starts in sorted(regions.items()):
            if (best := self._verify(docs[t], item, sorted(set(starts)))) is not None:
                yield t, item, *best

    def _verify(self, numbers: np.ndarray, item: int, starts: list[int]) -> tuple[int, int, int] | None:
        words = self.items[item]
        n = len(words)
        k = budget(n, self.similarity)
        masks: dict[int, int] = defaultdict(int)
        for i, w in enumerate(words):
            masks[w] |= 1 << i
        back = {w: int(format(m, f"0{n}b")[::-1], 2) for w, m in masks.items()}
        best = None
        lo, end = starts[0], starts[0]
        spans = []
        for s in [*starts[1:], None]:
            if s is None or s > end + n:
                spans.append((max(0, lo - k), end + n + 2 * k))
                lo = s
            end = s
        for lo, hi in spans:
            run = numbers[lo:hi].tolist()
            distance, stop = infix_distance(masks, n, run)
            if distance <= k and (best is None or distance < best[0]):
                _, length = infix_distance(back, n, run[:stop][::-1], anchored=True)
                best = (distance, lo + stop - length, length)
        return best


def blocks(benchmark: DataFrame, similarity: float, recall: float) -> Iterator[Index]:
    """An Index for every BLOCK_WORDS words (or one longer item) of the distinct items."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    least = F.min(F.struct(F.col("item_id").isNull(), F.col("item_id")))
    items = (benchmark.select("item_id", "text").withColumn("n", F.size(words)).where("n > 0")
             .groupBy("text").agg(least.alias("who"), F.max("n").alias("n")))
    total = items.agg(F.sum("n")).first()[0] or 0
    count = -(-total // BLOCK_WORDS)
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == b).select("who.item_id", "text").collect()
        by_words: dict[tuple[str, ...], int | None] = {}
        for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0)):
            found = tuple(re.findall(WORD, r.text.lower()))
            if found:
                by_words.setdefault(found, r.item_id)
        if by_words:
            yield Index([(i, list(w)) for w, i in by_words.items()], similarity, recall)


MATCHES = "doc_id long, item_id long, distance int, similarity double, first_word int, n_words int"


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, distance, similarity, first_word, n_words): one row for each document and
    leaked item, with the run of words of the smallest distance."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], MATCHES)
    for index in blocks(benchmark, similarity, recall):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in pieces(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], own.ids[i], d, 1 - d / len(own.items[i]), at, size)
                        for t, i, d, at, size in own.search([x or "" for x in batch.column("text").to_pylist()])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()))],
                        names=["doc_id", "item_id", "distance", "similarity", "first_word", "n_words"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, MATCHES))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` without the documents that hold a leak."""
    for index in blocks(benchmark, similarity, recall):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                bad = {t for t, *_ in shared.value.search([x or "" for x in batch.column("text").to_pylist()])}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
