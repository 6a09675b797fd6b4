"""SimHash near-dedup with pigeonring filtering (operator 1).

Fingerprints: ASCII-lower-cased words, word shingles, XXH64 with seed 42, majority per bit.

Linking at up to t differing bits: the 64 bits form a ring of m = t + 1 segments.  If two
fingerprints differ in at most t bits, some segment starts a chain along the ring in which the
first l segments differ in at most floor(l * t / m) = l - 1 bits, for every l (the pigeonring
principle).  The first two links of that chain are the join key - the start segment is equal, the
next one differs in at most one bit - so candidates meet on about 128 / m bits instead of 64 / m.
Of a pair whose next segments differ in one bit, exactly one has an even number of ones there, and
only that side sends out the flipped keys.  The rest of the chain, its smallest start (so that a
pair comes up once) and the full distance are checked inside the join.

Only distinct fingerprints are joined: copies are one class.  Components come from star rounds.

Defined cases: a text without words (null, empty, blank) has fingerprint 0 and is linked like any
other; fewer words than a shingle make one shingle; null ids are ignored when the smallest id is
sought (a component of null ids only has a null id); repeated rows each get their row; texts are
read in blocks, so a very long one needs no more memory; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centwise.llm.common import ASCII_LOWER, ASCII_UPPER, materialize, pieces, read
from centwise.llm.graph import components

SEED = 42
BLOCK = 1 << 20


def word_blocks(data: bytes, size: int, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists that overlap by ``size - 1`` words."""
    blank = re.compile(rb"[\x20\x09-\x0D]")
    tail: list[bytes] = []
    start = 0
    while start < len(data):
        cut = blank.search(data, min(start + block, len(data)))
        end = cut.start() if cut else len(data)
        words = tail + data[start:end].split()
        if len(words) > len(tail):
            yield words
            tail = words[max(0, len(words) - size + 1):]
        start = end


def fingerprint(text: str | None, size: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data = (text or "").encode().translate(bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode()))
    ones, count, short = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data, size):
        if len(words) < size:
            short = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])[:len(words) - size + 1]
        found = [digest(joined[a:b], SEED) for a, b in zip(begins.tolist(), ends[size - 1:].tolist())]
        bits = np.array(found, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(found)
    if not count and short:
        return digest(b" ".join(short), SEED)
    return sum(1 << i for i in range(64) if 2 * ones[i] > count)


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long, and a hash of the text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [fingerprint(t.as_py(), size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", "text_hash", "fp"])

    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    schema = base.drop("text").schema.add("fp", "long")
    return base.mapInArrow(run, schema)


def _segments(bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the ``bits + 1`` segments."""
    m = bits + 1
    widths = [64 // m + (j < 64 % m) for j in range(m)]
    return [(sum(widths[:j]), w) for j, w in enumerate(widths)]


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(u, v): pairs of the distinct fingerprints ``fp`` that differ in 1 to ``bits`` bits, each once."""
    if bits < 1:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    ring = _segments(bits)
    m = len(ring)

    def part(x, j):
        offset, width = ring[j % m]
        return F.shiftrightunsigned(x, offset).bitwiseAND(F.lit((1 << width) - 1))

    def key(j, flip=0):
        # a hash collision only adds a candidate: the join checks the chain itself
        nxt = part(F.col("fp"), j + 1).bitwiseXOR(F.lit(flip).cast("long"))
        return F.xxhash64(F.lit(j), part(F.col("fp"), j), nxt)

    def even(j):
        return F.bit_count(part(F.col("fp"), j + 1)) % 2 == 0

    if bits > 31:
        raise ValueError("bits must be at most 31")
    index = distinct.select(F.col("fp").alias("v"), F.posexplode(F.array(*[key(j) for j in range(m)])).alias("start", "key"))
    flips = [F.when(even(j), F.array(*[F.struct(F.lit(j).alias("start"), key(j, 1 << b).alias("key"), F.lit(True).alias("flipped"))
                                       for b in range(ring[(j + 1) % m][1])])) for j in range(m)]
    plain = F.array(*[F.struct(F.lit(j).alias("start"), key(j).alias("key"), F.lit(False).alias("flipped")) for j in range(m)])
    none = F.filter(plain, lambda _: F.lit(False))
    probe = (distinct.select(F.col("fp").alias("u"), F.explode(F.concat(plain, *[F.coalesce(f, none) for f in flips])).alias("p"))
             .select("u", "p.key", F.col("p.start").alias("probe_start"), "p.flipped"))
    apart = F.col("u").bitwiseXOR(F.col("v"))
    d = [F.bit_count(part(apart, j)) for j in range(m)]

    def viable(j):
        total, ok = F.lit(0), F.lit(True)
        for step in range(m):
            total = total + d[(j + step) % m]
            ok = ok & (total <= step)
        return ok

    first = F.coalesce(*[F.when(viable(j), F.lit(j)) for j in range(m)], F.lit(-1))
    # both sides are many times the table that Spark takes their size from: never broadcast
    return (index.hint("merge").join(probe, (index["key"] == probe["key"]) & (F.col("start") == F.col("probe_start"))
                       & (F.col("flipped") | (F.col("v") < F.col("u"))) & (first == F.col("start"))
                       & F.bit_count(apart).between(1, bits))
            .select("u", "v"))


def near_duplicates(docs: DataFrame, size: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component_id): component_id is the smallest doc_id of the component."""
    spark = docs.sparkSession
    rows = materialize(spark, fingerprints(docs, size), "fingerprints")
    classes = materialize(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes, bits)).select(F.col("node").alias("fp"), "root")
    labelled = classes.hint("merge").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    # left joins whose every row has its match: only the right side, measured while it runs, may be broadcast
    by_fp = labelled.join(least, "root", "left").select("fp", "component_id")
    return rows.join(by_fp, "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (of rows repeating that
    id, the one with the smallest text hash)."""
    found = near_duplicates(docs, size, bits)
    one = (found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
           .select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash")))
    hashed = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = hashed.join(one, (F.col("__text") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    again = Window.partitionBy("__text", "doc_id").orderBy(F.lit(0))
    return kept.withColumn("__n", F.row_number().over(again)).where("__n = 1").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"), 4, 4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
