import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from centwise.llm import mixing

WORD = re.compile("[^\x20\x09-\x0D]+")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def filled(sizes, weights, cap):
    """Targets by the rule as stated: share out, cut at the cap, share the excess again."""
    target = {s: 0.0 for s in sizes}
    rest, still = float(sum(sizes.values())), set(sizes)
    while still and rest > 1e-9:
        w = sum(weights[s] for s in still)
        for s in still:
            target[s] += rest * weights[s] / w
        rest = 0.0
        for s in [s for s in still if target[s] >= cap * sizes[s]]:
            rest += target[s] - cap * sizes[s]
            target[s] = float(cap * sizes[s])
            still.discard(s)
    return target


def brute(rows, copies, cap=3):
    sized = [(i, s, len(WORD.findall(t or "")), md5(t or "")) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in sized:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    target = filled(sizes, {s: 1 + k % 3 for k, s in enumerate(order)}, cap)
    out = []
    for s in order:
        seen, keyed = Counter(), []
        for r in (r for r in sized if r[1] == s):
            part = seen[r] // copies
            seen[r] += 1
            keyed.append((md5(f"mix:{'' if r[0] is None else r[0]}:{r[3]}:{part}"), r))
        budget = int(target[s] + 0.5)
        left = budget
        taken = [0] * len(keyed)
        keyed.sort(key=lambda x: x[0])
        while left and sizes[s]:                           # epoch after epoch, document after document
            for k, (_, r) in enumerate(keyed):
                step = min(r[2], left)
                taken[k] += step
                left -= step
        out += [(r[0], s, r[2], sizes[s], round(target[s], 6), t) for (_, r), t in zip(keyed, taken)]
    return Counter(out)


def rows_of(case):
    if case == "small":                                    # a source far below its share: three epochs and reshared excess
        return [(i, "w " * (i % 7), f"s{i % 4}") for i in range(200)] + [(900 + i, "big " * 400, "s9") for i in range(10)]
    if case == "odd":
        return [(None, "null id", "a"), (1, None, "a"), (1, "", "a"), (2, "only null source here", None), (3, " \t\n", "empty"),
                (4, "  is a word 　", "é"), (5, "x " * 5000, "Z"), (6, "tie", "b"), (7, "tie", "b")]
    return [(7, "hot row of words", "hot")] * 500 + [(i, f"text {i} " * (i % 5), "cold") for i in range(300)]


@pytest.mark.parametrize("case", ["small", "odd", "hot"])
@pytest.mark.parametrize("parts", [1, 9])
def test_mix_against_brute_force(spark, case, parts):
    rows = rows_of(case)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    df = df.withColumns({c: F.lit("clash") for c in ("size", "key", "target", "bucket", "copies")})
    got = mixing.mix(df, copies=20, rows_per_bucket=15).collect()
    assert Counter((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == brute(rows, 20)
    assert all(r.taken <= 3 * r.size for r in got)


def test_hot_rows_spread_over_buckets(spark):
    df = spark.createDataFrame([(7, "hot row", "hot")] * 4000, "doc_id long, text string, source string")
    recs = mixing.records(df, copies=10)
    assert recs.count() == 400 and recs.select("key").distinct().count() == 400


def test_mixture_gives_the_words_taken(spark):
    rows = rows_of("small")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    took = {r.doc_id: r.taken for r in mixed.collect()}
    words = Counter()
    for r in mixing.mixture(df, mixed).collect():
        assert len(WORD.findall(r.text)) == r.words
        words[r.doc_id] += r.words
    assert words == Counter({k: v for k, v in took.items() if v})


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == []
    assert mixing.mixture(empty, mixing.mix(empty)).collect() == []
