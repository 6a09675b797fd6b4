import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from centwise.llm import lines, sharding

STRIP = " \t\n\x0b\x0c\r"


def lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_docs, keep="none"):
    docs = {(i, t or "") for i, t in rows}
    where = defaultdict(set)
    for i, t in docs:
        for p, x in enumerate(t.split("\n")):
            if k := lowered(x.strip(STRIP)):
                where[k].add(((i is not None, i or 0), t, p))
    out = {}
    for i, t in docs:
        kept = []
        for p, x in enumerate(t.split("\n")):
            k = lowered(x.strip(STRIP))
            if k and len({(a, b) for a, b, _ in where[k]}) >= min_docs:
                continue
            kept.append(x)
        out[i, t] = (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    texts = ["Menu\nhome\nbody %d\n\n  MENU\t\nend" % i for i in range(12)] + ["home\nx", "", None, "\n", "only Émenu\r\nmenu",
             "a\n" * 500 + "menu\n" * 400, "hot\n" * 3]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "menu\nnull id"), (3, "menu\nother text, same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("pos", F.lit(1))
    got = lines.apply_bitmaps(df, lines.keep_bitmaps(df)).collect()
    want = brute(rows, 10)
    assert len(got) == len(rows)
    seen = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got)
    assert seen == Counter((i, *want[i, t or ""]) for i, t in rows)


def test_every_hot_key_is_salted(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    # 100 keys, each of a hundredth of all lines: far over 64, each over a quarter of a partition of 40
    rows = [(i, "\n".join(f"Line {j}" for j in range(100)) + f"\nown {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        occ = lines.occurrences(df, 1)
        assert lines._hot_keys(occ).count() == 100
        monkeypatch.setattr(lines, "SAMPLED", 60)          # a sample of some 2400 of 6060 occurrences
        assert 90 <= lines._hot_keys(occ).count() <= 100
        for keep in ("none", "first"):
            got = {r.doc_id: r.text for r in lines.apply_bitmaps(df, lines.keep_bitmaps(df, keep=keep)).collect()}
            assert got[0] == ("own 0" if keep == "none" else rows[0][1]) and all(got[i] == f"own {i}" for i in range(1, 60))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_keeps_first(spark):
    rows = [(i, "same\nline %d\nsame" % i) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.apply_bitmaps(df, lines.keep_bitmaps(df, min_docs=1, keep="first")).collect()}
    assert got[0] == "same\nline 0" and all(got[i] == f"line {i}" for i in range(1, 15))
    assert lines.apply_bitmaps(df.limit(0), lines.keep_bitmaps(df.limit(0))).collect() == []


def test_sharding(spark):
    rows = [(i, "t" * (i * 7919 % 400)) for i in range(3000)] + [(10_000 + i, "hot copy") for i in range(2000)]
    rows += [(None, "null id"), (5, None), (5, None), (77, "é" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    got = sharding.assign(df, 16, ranges=32, sample=500, rows_per_range=100).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(held) == set(range(16))
    assert max(held.values()) - min(held.values()) < 2 * max(size(t) for _, t in rows)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign(df.limit(0)).collect() == []
    few = sharding.assign(df.limit(3)).collect()
    assert len(few) == 3 and all(0 <= r.shard < 16 for r in few)


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    a = sharding.assign(df, 4)
    sharding.write_shards(df, a, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50
    assert {r.doc_id: hashlib.md5(r.text.encode()).hexdigest() for r in back.collect()} == {
        i: hashlib.md5(b"x" * i).hexdigest() for i in range(50)}


def test_equal_rows_fill_many_subranges(spark):
    df = spark.range(400_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    ordered, total = sharding.ranged(sharding.records(df), 256, 20_000, 50_000)
    rows = [r["count"] for r in ordered.groupBy("range", "part").count().collect()]
    assert total == 400_000 and len(rows) >= 8 and max(rows) < 100_000
    got = sharding.assign(df.limit(30_000), 16, rows_per_range=2_000).groupBy("shard").agg(
        F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(got) == 16 and all(r.n == 1875 and r.last == 1874 for r in got)
