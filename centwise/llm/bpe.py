"""Byte-level BPE encoding and decoding (operator 10).

A text is split by the tokenizer's pattern; the bytes of every match start as one token each.
A segment tree over the byte positions holds, for each live position, the rank of the pair it
forms with its right neighbour; ``rank * size + position`` makes the root the *leftmost minimum*.
A merge updates three leaves - the merged position, the swallowed one and the live left
neighbour - each along one path to the root, so a match of n bytes costs O(n log n).

Distinct matches are encoded once per task cache.  Matches of up to ``BATCH_BYTES`` bytes are
merged side by side as numpy rows, one tree per row; longer ones use a tree of their own.

Defined cases: a null text counts as the empty text (no tokens); empty texts give an empty id
list; repeated rows are encoded alike, row by row; very long matches only cost O(n log n); the
result keeps every input column unless it clashes with an output column, which then wins.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from centwise.llm.common import pieces, read

BATCH_BYTES = 64
CACHE_PIECES = 100_000
NONE = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """Ranks by bytes, and the same ranks as a sorted table of token pairs."""

    tokens: list[bytes]          # by id
    byte_ids: np.ndarray         # id of each single byte
    pair_keys: np.ndarray        # left id << 32 | right id, sorted
    pair_ranks: np.ndarray
    whole: dict[bytes, int]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair is no token."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a rank file (base64 token, rank); the driver does this once."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs: dict[int, int] = {}
    for token, rank in ranks.items():
        tokens[rank] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.fromiter(pairs, np.int64, len(pairs))
    order = np.argsort(keys)
    return Vocabulary(tokens, np.array([ranks[bytes([b])] for b in range(256)], np.int64), keys[order],
                      np.fromiter(pairs.values(), np.int64, len(pairs))[order], ranks)


def merge_rows(rows: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Token ids of each byte string; all rows go through their trees side by side."""
    count, width = len(rows), max(map(len, rows))
    size = 1 << max(1, (width - 1).bit_length())
    lengths = np.fromiter(map(len, rows), np.int64, count)
    flat = np.zeros((count, size + 1), np.int64)
    filled = np.arange(size + 1) < lengths[:, None]
    flat[filled] = vocab.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
    after = np.broadcast_to(np.arange(1, size + 2), (count, size + 1)).copy()
    before = np.broadcast_to(np.arange(-1, size), (count, size + 1)).copy()
    tree = np.full((count, 2 * size), NONE)
    rank = vocab.rank_of(flat[:, :size], flat[:, 1:])
    good = (rank >= 0) & (np.arange(1, size + 1) < lengths[:, None])
    tree[:, size:][good] = (rank * size + np.arange(size))[good]
    for node in range(size - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    live = filled.copy()

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + size
        tree[row, node] = value
        for _ in range(size.bit_length() - 1):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def pair_value(row: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
        inside = right < lengths[row]
        found = vocab.rank_of(flat[row, at], flat[row, np.where(inside, right, at)])
        return np.where(inside & (found >= 0), found * size + at, NONE)

    row = np.flatnonzero(tree[:, 1] < NONE)
    while len(row):
        best = tree[row, 1]
        at = best % size
        gone = after[row, at]
        right = after[row, gone]
        flat[row, at] = best // size
        live[row, gone] = False
        after[row, at] = right
        inner = right < lengths[row]
        before[row[inner], right[inner]] = at[inner]
        put(row, gone, np.full(len(row), NONE))
        put(row, at, pair_value(row, at, right))
        left = before[row, at]
        has = left >= 0
        if has.any():
            put(row[has], left[has], pair_value(row[has], left[has], at[has]))
        row = row[tree[row, 1] < NONE]
    ids = flat[live]
    return np.split(ids, np.cumsum(live.sum(axis=1))[:-1])


def merge_long(data: bytes, vocab: Vocabulary) -> np.ndarray:
    """The same for one long byte string, with plain lists."""
    n = len(data)
    size = 1 << (n - 1).bit_length()
    start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    none = int(NONE)
    tree = [none] * (2 * size)
    rank = vocab.whole.get

    def value(at: int, right: int) -> int:
        found = rank(data[at:end[right]]) if right < n else None
        return none if found is None else found * size + at

    for at in range(n - 1):
        tree[size + at] = value(at, at + 1)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(leaf: int, new: int) -> None:
        node = leaf + size
        tree[node] = new
        while node > 1:
            node >>= 1
            low, high = tree[2 * node], tree[2 * node + 1]
            tree[node] = low if low < high else high

    while tree[1] < none:
        at = tree[1] % size
        gone = after[at]
        right = after[gone]
        end[at], after[at], start[gone] = end[gone], right, -1
        if right < n:
            before[right] = at
        put(gone, none)
        put(at, value(at, right))
        if before[at] >= 0:
            put(before[at], value(before[at], at))
    return np.array([vocab.whole[data[s:end[s]]] for s in start if s >= 0], np.int64)


def encode_distinct(new: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Little-endian 32-bit ids of each byte string (each non-empty)."""
    out: list[bytes] = [b""] * len(new)
    by_size: dict[int, list[int]] = {}
    for i, data in enumerate(new):
        known = vocab.whole.get(data)
        if known is not None:
            out[i] = known.to_bytes(4, "little")
        elif len(data) > BATCH_BYTES:
            out[i] = merge_long(data, vocab).astype("<u4").tobytes()
        else:
            by_size.setdefault((len(data) - 1).bit_length(), []).append(i)
    for log, members in by_size.items():
        step = max(1, 60_000 >> log)
        for k in range(0, len(members), step):
            part = members[k:k + step]
            for i, ids in zip(part, merge_rows([new[i] for i in part], vocab)):
                out[i] = ids.astype("<u4").tobytes()
    return out


def latin_pattern(pattern: str):
    """``pattern`` for the standard library, right for texts below U+0250, where its classes are
    written out; None if the pattern holds what this rewriting does not cover."""
    import regex

    def ranges(kind: str) -> str:
        codes = [c for c in range(0x250) if regex.match(kind, chr(c))]
        cuts = [i for i in range(len(codes)) if i == 0 or codes[i] != codes[i - 1] + 1] + [len(codes)]
        return "".join(f"\\u{codes[a]:04x}-\\u{codes[b - 1]:04x}" for a, b in zip(cuts, cuts[1:]))

    out, inside, i = [], False, 0
    while i < len(pattern):
        token = re.match(r"\\p\{\w+\}|\\.|.", pattern[i:], re.S)[0]
        i += len(token)
        if token in ("[", "]") and inside == (token == "]"):
            inside = not inside
        elif token == r"\s" or token.startswith(r"\p{"):
            token = ranges(token) if inside else f"[{ranges(token)}]"
        elif token == r"\S" and not inside:
            token = f"[^{ranges(chr(92) + 's')}]"
        elif token[0] == "\\" and token[1:].isalpha():
            return None
        out.append(token)
    return re.compile("".join(out))


class Encoder:
    """Splits texts and encodes each distinct match once, with a cache of bounded size."""

    def __init__(self, vocab: Vocabulary, pattern: str) -> None:
        import regex

        self.vocab, self.cache = vocab, {}
        self.split = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.split_latin = latin.findall if latin else None
        self.wide = re.compile("[^\x00-\u024f]").search

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cuts = [(self.split if self.split_latin is None or self.wide(t) else self.split_latin)(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache = {}
        cache = self.cache
        new = list({p for cut in cuts for p in cut if p not in cache})
        cache.update(zip(new, encode_distinct([p.encode() for p in new], self.vocab)))
        return [b"".join(map(cache.__getitem__, cut)) for cut in cuts]


def text_groups(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of some ``most`` characters, with the row at which each starts."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= most:
            yield start, texts[start:i + 1]
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(fields))


def _kept(batch: pa.RecordBatch, schema: T.StructType) -> list[pa.Array]:
    at = {name: i for i, name in enumerate(batch.schema.names)}
    return [batch.column(at[f.name]) for f in schema if f.name in at]


def encode(docs: DataFrame, vocab_path: str, pattern: str, text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the token ids (array<int>) of ``text_col``."""
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path))
    schema = _with(docs.schema, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False))
    rest = T.StructType([f for f in schema if f.name != ids_col])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value, pattern)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for start, group in text_groups(texts):
                done = encoder(group)
                offsets = np.concatenate([[0], np.cumsum([len(d) // 4 for d in done])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(done), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [*_kept(batch.slice(start, len(group)), rest), ids], names=[*rest.names, ids_col])

    return docs.mapInArrow(run, schema)


def id_arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row; none for a null."""
    for i in range(len(column)):
        yield column.slice(i, 1).flatten().to_numpy(zero_copy_only=False)


def bytes_of(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``bytes_col``: the bytes (binary) that its ids stand for; null ids give none."""
    tokens = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path).tokens)
    schema = _with(encoded.schema, T.StructField(bytes_col, T.BinaryType(), False))
    rest = T.StructType([f for f in schema if f.name != bytes_col])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            data = [bytes_of(ids, tokens.value) for ids in id_arrays(batch.column(ids_col))]
            yield pa.RecordBatch.from_arrays([*_kept(batch, rest), pa.array(data, pa.binary())],
                                             names=[*rest.names, bytes_col])

    return encoded.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, number of tokens, SHA-256 of the ids (little-endian u32) and of the bytes they decode to."""
    tokens = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path).tokens)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            arrays = list(id_arrays(batch.column(ids_col)))
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col).cast(pa.int64()), pa.array([len(x) for x in arrays], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in arrays], pa.string()),
                pa.array([hashlib.sha256(bytes_of(x, tokens.value)).hexdigest() for x in arrays], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(id_col, ids_col).mapInArrow(run, DIGESTS)


def round_trip(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """The digest columns of ``docs`` (doc_id, text), encoded and decoded again."""
    encoded = encode(docs.select("doc_id", "text"), vocab_path, pattern).select("doc_id", "ids")
    return digests(encoded, vocab_path)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"),
                      public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
