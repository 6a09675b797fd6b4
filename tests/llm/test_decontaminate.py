import random
import re

import numpy as np
from pyspark.sql import functions as F

from centwise.llm import decontaminate as dc


def infix(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != w)))
        row = new
    return min(row)


def corpus():
    rng = random.Random(9)
    vocab = ["w%d" % i for i in range(300)] + ["the", "of", "and"] * 40
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [make(n) for n in (1, 2, 4, 5, 7, 12, 15, 20, 33, 34, 35, 60, 60)]
    items[0] = ["solitary"]
    docs = []
    for _ in range(260):
        words = make(rng.randint(5, 300))
        if rng.random() < .75:
            it = list(rng.choice(items))
            k = rng.randint(0, max(1, int(len(it) * .3)))
            for _ in range(k):
                p = rng.randrange(len(it) + 1)
                kind = rng.random()
                if kind < .4 and p < len(it):
                    it[p] = rng.choice(vocab)
                elif kind < .7 and len(it) > 1 and p < len(it):
                    del it[p]
                else:
                    it.insert(p, rng.choice(vocab))
            at = rng.randrange(len(words) + 1)
            words[at:at] = it
        docs.append(" ".join(w.upper() if rng.random() < .1 else w + rng.choice(["", "", ",", "."]) for w in words))
    return [" ".join(i) for i in items], docs


def test_matches_against_brute_force(spark):
    items, docs = corpus()
    bench = [(i * 5, t) for i, t in enumerate(items)] + [(3, items[8].upper()), (None, items[9]), (None, None), (90, " . ")]
    rows = list(enumerate(docs)) + [(1000, None), (1001, ""), (None, items[10]), (7, docs[7]), (2000, "the " * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.distance) for r in dc.matches(d, b).collect()]
    want, split = set(), lambda t: re.findall(r"\w+", (t or "").lower())
    for i, t in rows:
        for j, x in enumerate(items):
            n = len(split(x))
            e = infix(split(x), split(t))
            if e <= dc.budget(n, .8):
                want.add((i, 3 if j == 8 else j * 5, e))
    assert set(got) <= want
    assert len(set(got)) >= .99 * len(want) and len(want) > 100
    exact = {w for w in want if w[2] == 0}
    assert exact <= set(got)
    kept = [r.doc_id for r in dc.decontaminate(d, b).collect()]
    assert sorted(kept, key=str) == sorted([i for i, _ in rows if i not in {g[0] for g in got}], key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.matches(d, b.limit(0)).collect() == []
    assert dc.matches(d.limit(0), b).collect() == []
    assert dc.decontaminate(d, b.limit(0)).count() == 1


def test_long_documents_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 30)
    items, _ = corpus()
    long = "filler word " * 30_000 + items[11] + " more filler" * 1000
    d = spark.createDataFrame([(1, long), (2, "clean text")], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items[5:])), "item_id long, text string")
    r = dc.matches(d, b).collect()
    assert [(x.doc_id, x.item_id, x.distance, x.first_word, x.n_words) for x in r] == [(1, 6, 0, 60_000, 60)]


def planted(n, count, rng):
    """Items of n words and texts in which each leaks with every fifth word replaced."""
    items = [[f"v{i}x{j}" for j in range(n)] for i in range(count)]
    leaks = [list(x) for x in items]
    k = dc.budget(n, .8)
    for x in leaks:
        for j in range(k):
            x[j * n // k] = f"new{rng.randrange(10 ** 9)}"
    return items, [" ".join(["before"] * 30 + x + ["after"] * 30) for x in leaks]


def test_recall_on_long_items():
    rng, lengths, found = random.Random(3), (94, 125, 161, 199, 245), 0
    for n in lengths:
        items, texts = planted(n, 120, rng)
        matches = {(t, i) for t, i, *_ in dc.Index(list(enumerate(items)), .8, .99).search(texts)}
        found += len(matches & {(i, i) for i in range(120)})
    assert found >= .99 * 120 * len(lengths)


def test_recall_with_deleted_words():
    for n in (55, 94, 161):
        items, _ = planted(n, 100, random.Random(n))
        drop = {j * n // dc.budget(n, .8) for j in range(dc.budget(n, .8))}
        texts = [" ".join(["before"] * 30 + [w for j, w in enumerate(x) if j not in drop] + ["after"] * 30) for x in items]
        found = {(t, i) for t, i, *_ in dc.Index(list(enumerate(items)), .8, .99).search(texts)}
        assert len(found & {(i, i) for i in range(100)}) >= 99, n


def test_recall_of_each_length():
    rng = np.random.default_rng(5)
    for n in [*range(5, 101), 125, 161, 199, 245]:
        k, reps = dc.budget(n, .8), dc.repetitions(n)
        items = rng.integers(1, 1 << 30, (200, n))
        own = dc.cgk_samples(items, reps)
        for first in range(n // k):
            leaks = items.copy()
            leaks[:, np.arange(k) * n // k + first] += 1 << 30
            met = (own == dc.cgk_samples(leaks, reps)).mean(1)
            assert 1 - np.prod(1 - met) >= dc.RECALL, (n, first)


def test_unrelated_windows_rarely_meet():
    rng = np.random.default_rng(6)
    for n in (2, 10, 20, 30, 50, 60, 65, 80, 100, 161, 245):
        items, others = rng.integers(1, 1 << 30, (2, 200, n))
        reps = dc.repetitions(n)
        met = (dc.cgk_samples(items, reps) == dc.cgk_samples(others, reps)).any(0)
        assert met.mean() <= .01, n
