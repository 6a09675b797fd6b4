import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from centwise.llm import warc


def pages():
    big = "<p>" + "é tea \r\n\r\nWARC/1.1\r\n\n" * 20
    return [(1, "http://a/1", big), (2, "http://a/2 b\tc", big), (4, None, big), (3, "http://a/3", "x" * 99), (5, "http://a/5", "x" * 99),
            (6, "http://a/6", "y" * 100), (7, "http://a/7", "y" * 100), (8, "http://a/8", None), (9, "u", ""), (10, "", "\n"),
            (None, "http://n", big), (20, "http://r", "z" * 500), (20, "http://r", "z" * 500), (30, "http://l", "long " * 200_000)]


def want(rows):
    size = lambda h: len((h or "").encode())
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for h, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            again = size(h) >= 100 and k > 0
            out.append((i, size(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("record_id", F.lit("clash"))
    got = warc.archive_pages(df.repartition(3)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == Counter(want(pages()))
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_arc_versions_and_lengths():
    body = b"HTTP/1.0 200 OK\r\n\r\nhello\nworld"
    v1 = warc.arc_head(1, "a.arc") + b"\n" + b"http://x/a b 1.2.3.4 19990203040506 text/html %d\n" % len(body) + body + b"\n"
    v2 = warc.arc_head(2, "b.arc") + b"\nhttp://x 1.2.3.4 19990203040506 text/html 200 - - 17 b.arc %d\n" % len(body) + body + b"\n\n"
    for data, version in ((v1, 1), (v2, 2)):
        (r,) = warc.arc_records(gzip.compress(data))
        assert (r["version"], r["block"], r["Archive-date"], r["Content-type"]) == (version, body, "19990203040506", "text/html")
    (r,) = warc.arc_records(gzip.compress(v1))
    assert r["URL"] == "http://x/a%20b"
    members = gzip.compress(v2[:50]) + gzip.compress(v2[50:])
    assert len(list(warc.arc_records(members))) == 1
    with pytest.raises(ValueError):
        list(warc.arc_records(gzip.compress(v1[:-10])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.arc_records(gzip.compress(b"no archive 5\nabcde")))
