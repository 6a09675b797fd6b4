import numpy as np
from pyspark.sql import functions as F

from centwise.llm import negatives

SCHEMA = "id long, label long, v array<long>"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), LEAST), MOST)


def brute(rows, step=10, k=5, n=5):
    rows = list({(i, lab, tuple(v)) for i, lab, v in rows if lab is not None and v is not None and None not in v})
    first = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, lab, v in rows:
        if a is None or a % step:
            continue
        others = [(i, la, dot(v, w)) for i, la, w in rows if i != a]
        pos = sorted(((i, s) for i, la, s in others if la == lab), key=lambda x: first(x[1], x[0]))[:k]
        for p, ps in pos:
            neg = sorted(((i, s) for i, la, s in others if la != lab and 80 * ps <= 100 * s <= 100 * ps),
                         key=lambda x: first(x[1], x[0]))[:n]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(neg, 1)]
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("slice", "block", "aid", "score")})
    return sorted(map(tuple, negatives.mine(df, "id % 10 = 0", **kw).collect()), key=str)


def clustered(n, dims=12, groups=6, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-200, 200, (groups, dims))
    return [(i, int(i // groups % 3), (middle[i % groups] + rng.integers(-6, 6, dims)).tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rows = clustered(400)
    rows += [(i, 0, [7] * 12) for i in range(400, 440)]                          # ties
    rows += rows[:15]                                                            # repeated rows
    rows += [(500, None, [1] * 12), (501, 1, None), (510, 1, [1, None]), (520, 2, []), (530, 1, [0] * 12), (540, 1, [9, 9]),
             (550, 7, [5] * 12), (None, 1, [8] * 12), (560, 1, [3] * 20), (10, 2, [60] * 12)]
    want = brute(rows)
    assert len(want) > 500
    assert got(spark, rows) == want
    assert got(spark, rows, slice_rows=40) == want


def test_huge_components(spark):
    rows = [(i, i % 2, [(1 << 40) + i, -(1 << 20) * i]) for i in range(40)] + [(90, 0, [1 << 62, 1 << 62]), (91, 1, [1 << 62, 3])]
    assert got(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert got(spark, []) == []
    assert got(spark, [(10, 1, [1, 2])]) == []
    assert got(spark, [(10, 1, [1, 2]), (11, 1, [1, 2])]) == []


def test_tree_is_minimum_and_bounds_hold():
    rng = np.random.default_rng(1)
    v = rng.integers(-300, 300, (80, 6))
    order, parent, edge = negatives.spanning_tree(v)
    assert sorted(order) == list(range(80)) and parent[0] == -1 and all(p < i for i, p in enumerate(parent))
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    joined, total = {0}, 0.0                                                     # a plain Kruskal-free check: cheapest edge out of the set
    while len(joined) < 80:
        d, j = min((far[i, j], j) for i in joined for j in range(80) if j not in joined)
        total += d
        joined.add(j)
    assert abs(total - sum(edge)) < 1e-6
    cands = rng.integers(-300, 300, (200, 6))
    for i, p in enumerate(parent[1:], 1):
        moved = np.abs(cands @ v[order[i]] - cands @ v[order[p]])
        assert (moved <= edge[i] * np.sqrt((cands ** 2).sum(axis=1)) + 1e-6).all()


def test_bounds_spare_work_on_near_anchors():
    rows = clustered(6000, dims=32, groups=30, seed=9)
    v, label = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    at = np.arange(0, 6000, 20)
    order, parent, edge = negatives.spanning_tree(v[at])
    at = at[order]
    block = {"aid": np.arange(len(at)), "id": at, "label": label[at], "parent": parent, "edge": edge, "v": v[at]}
    cand = {"id": np.arange(6000), "label": label, "v": v}
    windows = [[negatives.Best(5, float("-inf"), float("inf"))] for _ in at]
    rescored, looked = negatives.search(cand, block, windows, True)
    assert rescored < 0.1 * looked                         # a third of all pairs have the label
    for a, w in zip(at[:50], windows):
        s = v @ v[a]
        best = sorted((-x, i) for i, x in enumerate(s.tolist()) if i != a and label[i] == label[a])[:5]
        assert [(-x, i) for x, i in zip(w[0].scores, w[0].ids)] == best
