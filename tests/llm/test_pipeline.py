import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as pipe
from centwise.llm import decontaminate, quality
from tests.llm.test_decontaminate import infix
from tests.llm.test_lines_sharding import brute
from tests.llm.test_simhash import groups, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    kept = [pipe.STAGES[0][1](spark, docs, SF)]
    judged = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()
    good = {r.doc_id for r in judged}
    now = {r.doc_id: r.text for r in kept[0].collect()}
    assert kept[0].columns == docs.columns and set(now) == good and all(now[i] == rows[i].text for i in good)

    cut = pipe.STAGES[1][1](spark, kept[0], SF)
    want = brute(list(now.items()), 10)
    want = {i: w[2] for (i, _), w in want.items()}
    now = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and now == want

    one = pipe.STAGES[2][1](spark, cut, SF)
    fp = {i: slow_fingerprint(t) for i, t in now.items()}
    root = groups(set(fp.values()), [(a, b) for a in set(fp.values()) for b in set(fp.values()) if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i in now:
        least[root[fp[i]]] = min(i, least.get(root[fp[i]], i))
    now = {i: t for i, t in now.items() if i in least.values()}
    assert {r.doc_id: r.text for r in one.collect()} == now

    clean = pipe.STAGES[3][1](spark, one, SF)
    split = lambda t: re.findall(r"\w+", t.lower())
    items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = set()
    for i, t in now.items():
        words = split(t)
        for it in items:
            if set(it) & set(words) and len(set(it) & set(words)) >= .5 * len(set(it)) and infix(it, words) <= decontaminate.budget(len(it), .8):
                leaks.add(i)
                break
    now = {i: t for i, t in now.items() if i not in leaks}
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()} == now

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: np.array(enc.encode_ordinary(t), "<u4") for i, t in now.items()}
    want = {(i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(now[i].encode()).hexdigest()) for i, x in ids.items()}
    assert {tuple(r) for r in pipe.run(spark, SF).collect()} == want
