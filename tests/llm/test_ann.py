import numpy as np
from pyspark.sql import functions as F

from centwise.llm import ann

ASKS = "vec_id % 20 = 0"
SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i, tuple(v)] = np.array(v, np.float32).astype(np.float64)
    ids = np.array([i for i, _ in good])
    x = np.stack(list(good.values()))
    out = {}
    for n, (i, _) in enumerate(good):
        if i % 20 == 0:
            s = (x * x[n]).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def as_dict(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows, 20), as_dict(ann.search(df, ASKS, 20, slice_rows=2000, block_rows=100))
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= .93
    for q in want:
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in got[q] if i in exact)


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(80)] + [(5, rows[5][1])]           # a hot vector, a repeated row
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0] * 7 + [None]), (260, [1.0] * 7 + [float("nan")]),
             (280, [float("inf")] * 8), (300, [1.0, 2.0]), (None, rows[3][1]), (320, [10 * x for x in rows[7][1]])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cid", F.lit("clash")).withColumn("score", F.lit(1))
    got = as_dict(ann.search(df, ASKS, 20, target=1.0, slice_rows=17, block_rows=3))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 8], 20)
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= .9 * sum(map(len, want.values()))
    for asked in (0, 100):
        copies = [i for i, _ in got[asked] if i == 0 or 100 <= i < 180]
        assert copies and copies == [i for i in (0, *range(100, 180)) if i != asked][:len(copies)]
    few = as_dict(ann.search(df.where("vec_id < 5"), ASKS, 20))
    assert [len(v) for v in few.values()] == [4]
    assert ann.search(df.limit(0), ASKS, 20).collect() == []


def test_probing_is_exact():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    longest = np.linalg.norm(x, axis=1).max()
    model = ann.learn(ann.lift(x, longest), 64)
    part = ann.Slice(x, longest, model)
    for radius in (0, 5, 13, 24):
        for code in part.codes[:20]:
            want = np.flatnonzero(np.unpackbits(part.codes ^ code, axis=1).sum(1) <= radius)
            assert part.within(code, radius).tolist() == want.tolist()
