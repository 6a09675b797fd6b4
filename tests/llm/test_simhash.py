import random
import re

import xxhash
from pyspark.sql import functions as F

from centwise.llm import graph, simhash
from centwise.llm.graph import components


def slow_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)] + ["Été", "THE", "a\xa0b"]
    out = ["", None, " \n", "one", "two words", "a b c", "A B\tC\x0bd", "a b c d"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_fingerprint_by_blocks():
    for t in texts():
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    long = " ".join("x%d" % (i % 977) for i in range(30_000))
    want = slow_fingerprint(long)
    assert simhash.fingerprint(long) == want
    blocks = list(simhash.word_blocks(long.encode(), 4, 1000))
    assert sum(len(b) - 3 for b in blocks) == 30_000 - 3


def test_links_are_exact(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:100]:
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (1, 4, 7):
        got = [tuple(sorted((r.u & (2**64 - 1), r.v & (2**64 - 1)))) for r in simhash.links(df, bits).collect()]
        want = {tuple(sorted((a, b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}
        assert len(got) == len(set(got)) and set(got) == want


def test_components_and_keep_one(spark):
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts())] + [(1, ""), (None, "two words"), (None, "unique null id here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(0))
    rows = simhash.near_duplicates(df).collect()
    fp = {slow_fingerprint(t) for _, t in docs}
    root = groups(fp, [(a, b) for a in fp for b in fp if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, t in docs:
        if i is not None:
            r = root[slow_fingerprint(t)]
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, least.get(root[slow_fingerprint(t)])) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=repr) == want
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(root.values()))
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500), (500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_of_every_fingerprint_is_broadcast(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("fp")).write.parquet(str(tmp_path / "classes"))
    pairs = simhash.links(spark.read.parquet(str(tmp_path / "classes")))     # a small file, exploded to 40 times its rows
    assert "Broadcast" not in plan(pairs)
    want = {(a, b) for a in range(50) for b in range(50) if b < a and (a ^ b).bit_count() <= 4}
    assert {(r.u, r.v) for r in pairs.collect()} == want


def test_many_edges_are_not_broadcast(spark, tmp_path, monkeypatch):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    df.write.parquet(str(tmp_path / "edges"))
    stored = spark.read.parquet(str(tmp_path / "edges"))
    assert "Broadcast" not in plan(graph._large_star(stored, True)) and "Broadcast" not in plan(graph._small_star(stored, True))
    want = {r.node: r.root for r in components(df).collect()}
    seen = []
    monkeypatch.setattr(graph, "FEW", 10)
    monkeypatch.setattr(graph, "_large_star", lambda e, many, f=graph._large_star: (seen.append(many), f(e, many))[1])
    assert {r.node: r.root for r in components(df).collect()} == want and all(seen)
