import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from centwise.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def tik():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n \t x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't we'll I'm  two   spaces ",
       "Größe ñandú œuvre \u1234 漢字かな 😀👩‍👩‍👧", "\x1c\x1d\x85\xa0 a\u2028b\u3000", "x" * 3000, "é" * 700 + "1234" * 300,
       "²³¹½ ªº ǅ 123abc_!?--==", "\x00\x01\x7f\x80", "<|endoftext|>"]


def test_matches_tiktoken(spark):
    rng = random.Random(5)
    alphabet = "abc theANDing  .,!\n\t'éßñ漢😀012\x1c\xa0"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9999, None), (3, texts[3]), (None, "null id")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN)
    enc = tik()
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        want = enc.encode_ordinary(r.text or "")
        assert list(r.ids) == want, repr(r.text)
    for r in bpe.decode(got, PATH).collect():
        assert bytes(r.decoded).decode() == (r.text or "")


def test_long_and_batched_trees_agree():
    vocab = bpe.load_vocabulary(PATH)
    rng = random.Random(2)
    rows = [bytes(rng.choice(b"thean ingrsxz\xc3\xa9") for _ in range(rng.randint(1, 64))) for _ in range(400)]
    for row, ids in zip(rows, bpe.merge_rows(rows, vocab)):
        assert ids.tolist() == bpe.merge_long(row, vocab).tolist()


def test_digests_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "hello", 7, "z"), (2, None, 8, "y")], "doc_id long, text string, ids int, decoded string")
    r = {x.doc_id: x for x in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    ids = np.array(tik().encode_ordinary("hello"), "<u4")
    assert (r[1].n_tokens, r[1].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert r[1].decoded_sha256 == hashlib.sha256(b"hello").hexdigest()
    assert (r[2].n_tokens, r[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []
