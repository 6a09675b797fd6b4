import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from centwise.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    out = q.judge(docs, labels.where(half)).select("doc_id", "keep")
    rows = labels.where(~half).join(out, "doc_id").select("quality", "keep").collect()
    assert len(rows) > 150
    assert sum((r.quality == 1) == r.keep for r in rows) / len(rows) >= .97


def test_posteriors_against_plain_arithmetic(spark):
    rows = [(i, i, "big", "a" if i % 3 else None, .9 if i % 10 else .2) for i in range(60)]
    rows += [(100 + i, 0, "poor", "x", .1) for i in range(30)] + [(200, 0, None, None, .5), (201, 0, "lone", "y", .05)]
    df = spark.createDataFrame(rows, "doc_id long, text_hash long, host string, path string, p double")
    got = {r.doc_id: r for r in q.posteriors(df).collect()}
    assert len(got) == len(rows)
    hosts, paths = {}, {}
    for _, _, h, a, p in rows:
        for d, k in ((hosts, h), (paths, (h, a))):
            s, n = d.get(k, (0, 0))
            d[k] = (s + p, n + 1)
    mean = sum(p for *_, p in rows) / len(rows)

    kh, kp = q.strengths(df.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
    for i, _, h, a, p in rows:
        (hs, hn), (ps, pn) = hosts[h], paths[h, a]
        m = (kh * mean + hs - p) / (kh + hn - 1)
        m2 = (kp * m + ps - p) / (kp + pn - 1)
        odds = math.log(p / (1 - p)) - math.log(mean / (1 - mean)) + math.log(m2 / (1 - m2))
        assert got[i].posterior == pytest.approx(1 / (1 + math.exp(-odds)))
    assert got[105].path_posterior < got[201].path_posterior < got[1].path_posterior   # the lone site shrinks


def simulated(spark, hosts, paths, docs, of_host, of_path, seed=1):
    """Path sums of documents that are good or bad; the hosts' means and the paths' means are beta draws."""
    rng = np.random.default_rng(seed)
    rows = []
    for h in range(hosts):
        m = rng.beta(of_host * .4, of_host * .6)
        for a in range(paths):
            n = int(rng.integers(1, 2 * docs))
            share = m if of_path is None else rng.beta(max(of_path * m, 1e-3), max(of_path * (1 - m), 1e-3))
            rows.append((f"h{h}", f"a{a}", float(rng.binomial(n, share)), n))
    return spark.createDataFrame(rows, "host string, path string, s double, n long")


@pytest.mark.parametrize("of_host, of_path", [(4, 3), (4, 20), (30, 5)])
def test_strengths_of_a_simulation(spark, of_host, of_path):
    got = q.strengths(simulated(spark, 600, 10, 20, of_host, of_path))
    assert got == (pytest.approx(of_host, rel=.25), pytest.approx(of_path, rel=.25))


def test_paths_that_differ_by_chance_only(spark):
    rng = np.random.default_rng(2)
    rows = [(f"h{h}", f"a{a}", float(rng.binomial(20, .1 if h % 2 else .9)), 20) for h in range(40) for a in range(10)]
    paths = spark.createDataFrame(rows, "host string, path string, s double, n long")
    of_host, of_path = q.strengths(paths)
    assert of_host <= 1.5 and of_path > 100              # paths say nothing beyond their host
    assert q.strengths(simulated(spark, 600, 10, 20, 4, None))[1] > 200
    assert q.strengths(paths.limit(0)) == q.strengths(paths.limit(1).withColumn("n", F.lit(1).cast("long")))
    assert q.strengths(paths.limit(1).withColumn("s", F.lit(0.0)))[1] == q.NO_EVIDENCE


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "s", None, 1), (2, "", None, "en", 1), (2, "", None, "en", 1), (None, "word " * 9, "s", "en", 1)],
                                 "doc_id long, text string, source string, lang string, p int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.judge(docs, none).count() == 4 and q.keep_good(docs, none).count() == 4
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None), (77, 0)], "doc_id long, quality int")
    assert sorted(q.keep_good(docs, one).collect(), key=str) == sorted(docs.collect(), key=str)
    assert q.judge(docs.limit(0), one).count() == 0 and q.keep_good(docs.limit(0), none).count() == 0


def test_repeated_ids_draw_the_same_rows(spark):
    rows = [(i % 2, "Word, " * (i % 37 + 1) + "x" * i, "s", "en") for i in range(400)]
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    fits = [q.train(spark.createDataFrame(x, "doc_id long, text string, source string, lang string").coalesce(1), labels, 10)
            for x in (rows, rows[::-1], rows[200:] + rows[:200])]
    for mean, scale, w in fits[1:]:
        assert (mean == fits[0][0]).all() and (scale == fits[0][1]).all() and (w == fits[0][2]).all()


def test_rows_are_not_broadcast(spark, tmp_path):
    rows = [(i, i, f"h{i % 3}" if i % 4 else None, f"p{i % 2}", i % 10 / 10) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text_hash long, host string, path string, p double")
    df.coalesce(1).write.parquet(str(tmp_path / "scored"))
    out = q.posteriors(spark.read.parquet(str(tmp_path / "scored")))
    assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()      # the rows, at the size of their file
    assert out.where("host_posterior is not null and path_posterior is not null").count() == 100
