"""Byte-level BPE with a two-tier lookup, and its decoding.

A rank file gives the vocabulary, a pattern the pre-tokens. A pre-token that is in the vocabulary as a
whole is resolved by a minimal perfect hash: one probe and one comparison. Any other is merged pair by
pair, lowest rank first, over a linked list of its bytes with a heap of candidate pairs, which takes
``n log n`` steps for ``n`` bytes, so that one very long run without a break is no trouble. Results of
both are remembered up to a bound.

Null encodes like the empty text, to no ids. Repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from wellspan.llm.common import LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES, Memo, is_latin, map_batches, texts

# the public pattern with its classes spelled out for texts of Latin-1 code points
LATIN_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+"
    rf"| ?[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+|[{LATIN_SPACES}]+(?![^{LATIN_SPACES}])|[{LATIN_SPACES}]+")


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace): as many slots as keys.

    Keys are dealt to buckets by one half of their hash. Large buckets come first; each gets the first
    displacement that sends all its keys to free slots. Buckets of one key take a free slot by number.
    """

    def __init__(self, keys: list[bytes]):
        from xxhash import xxh3_128_intdigest

        self.size = n = max(1, len(keys))
        n_buckets = max(1, n // 2)
        hashes = [xxh3_128_intdigest(k) for k in keys]
        low = np.array([h & 0xFFFFFFFF for h in hashes], np.int64)
        step = np.array([h >> 32 & 0xFFFFFFFF | 1 for h in hashes], np.int64)
        buckets: list[list[int]] = [[] for _ in range(n_buckets)]
        for i, h in enumerate(hashes):
            buckets[(h >> 64) % n_buckets].append(i)
        self.shift = [0] * n_buckets
        key_at = np.full(n, -1, np.int64)
        order = sorted(range(n_buckets), key=lambda b: -len(buckets[b]))
        for b in order:
            own = np.array(buckets[b], np.int64)
            if len(own) < 2:
                break
            d = np.arange(1, 65)
            while True:
                slots = (low[own] + d[:, None] * step[own] & 0xFFFFFFFF) * n >> 32
                fits = (key_at[slots] < 0).all(axis=1)
                for row in np.flatnonzero(fits):
                    if len(set(slots[row].tolist())) == len(own):
                        break
                else:
                    d = d + 64
                    continue
                break
            self.shift[b] = int(d[row])
            key_at[slots[row]] = own
        free = iter(np.flatnonzero(key_at < 0).tolist())
        for b in order:
            if len(buckets[b]) == 1:
                s = next(free)
                self.shift[b] = -s - 1
                key_at[s] = buckets[b][0]
        self.key_at = key_at.tolist()

    def slot(self, h: int, d: int) -> int:
        return ((h & 0xFFFFFFFF) + d * ((h >> 32 & 0xFFFFFFFF) | 1) & 0xFFFFFFFF) * self.size >> 32

    def __call__(self, h: int) -> int:
        """The one key, by number, that a key with this hash can be."""
        d = self.shift[(h >> 64) % len(self.shift)]
        return self.key_at[-d - 1 if d < 0 else self.slot(h, d)]


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str, perfect: PerfectHash | None = None, remember: int = 300_000):
        from xxhash import xxh3_128_intdigest

        self.tokens, self.hash = tokens, xxh3_128_intdigest
        self.perfect = perfect or PerfectHash(tokens)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.single = [self.rank.get(bytes([b]), -1) for b in range(256)]
        self.pair = {(a, b): r for t, r in self.rank.items() if len(t) == 2 for a, b in [t]}
        self.find_any = regex.compile(pattern).findall
        self.memo = Memo(self._packed, remember)
        self.latin: Callable[[str], list[str]] | None = None

    @staticmethod
    def open(path: str, pattern: str) -> "Codec":
        import public_tokenizers

        codec = Codec(read_ranks(path), pattern)
        if pattern == public_tokenizers.PATTERN:
            codec.latin = LATIN_PATTERN.findall
        return codec

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.perfect(self.hash(piece))
        if whole >= 0 and self.tokens[whole] == piece:
            return [whole]
        return self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Ranks after all merges. Nodes are byte offsets, each linked to the next and the previous one."""
        n, rank = len(piece), self.rank.get
        if n < 2:
            return [self.single[b] for b in piece]
        heap = [(r, i, i + 2) for i, r in enumerate(map(self.pair.get, zip(piece, piece[1:]))) if r is not None]
        if not heap:
            return [self.single[b] for b in piece]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        name = [self.single[b] for b in piece]  # the token that starts at a node; None once merged into another
        while heap:
            r, i, end = pop(heap)
            j = after[i]
            if name[i] is None or j >= n or after[j] != end:
                continue  # one of the two has been merged since
            after[i] = end
            name[i], name[j] = r, None
            before[end] = i
            if end < n:
                last = after[end]
                x = rank(piece[i:last])
                if x is not None:
                    push(heap, (x, i, last))
            if i:
                p = before[i]
                x = rank(piece[p:end])
                if x is not None:
                    push(heap, (x, p, end))
        return [r for r in name if r is not None]

    def _packed(self, piece: str) -> bytes:
        ids = self.piece_ids(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        find = self.latin if self.latin and is_latin(text) else self.find_any
        out = b"".join(map(self.memo.__getitem__, find(text)))
        self.memo.trim()
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _codec(spark: SparkSession, path: str, pattern: str) -> Callable[[], Codec]:
    """Sends vocabulary and perfect hash to the workers, whose size is that of the vocabulary.

    A worker builds its codec once and keeps it, with what it remembers, for its later tasks.
    """
    codec = Codec.open(path, pattern)
    sent = spark.sparkContext.broadcast((codec.tokens, codec.perfect, codec.latin is not None))

    def get() -> Codec:
        if (path, pattern) not in _KEPT:
            _KEPT.clear()
            tokens, perfect, latin = sent.value
            own = _KEPT[path, pattern] = Codec(tokens, pattern, perfect)
            own.latin = LATIN_PATTERN.findall if latin else None
        return _KEPT[path, pattern]

    return get


_KEPT: dict[tuple[str, str], Codec] = {}


def _add(df: DataFrame, column: str, added: dict, make) -> DataFrame:
    kept = [c for c in df.columns if c not in added]
    extra = kept if column in kept else [*kept, column]
    fields = [StructField(k, v) for k, v in added.items()]
    schema = StructType([df.schema[c] for c in kept] + fields)

    def batches():
        work = make()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + work(batch), kept + list(added))

        return step

    return map_batches(df.select(*extra), batches, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` as packed little-endian 32-bit numbers, and ``n_tokens``."""
    get = _codec(df.sparkSession, path, pattern)

    def make():
        codec = get()

        def work(batch):
            packed = [codec.encode(t) for t in texts(batch, text)]
            return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]

        return work

    return _add(df, text, {ids: BinaryType(), "n_tokens": LongType()}, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the packed ``ids`` stand for; NULL ids give no bytes."""
    get = _codec(df.sparkSession, path, pattern)

    def make():
        codec = get()

        def work(batch):
            return [pa.array([codec.decode(p or b"") for p in batch.column(ids).to_pylist()], pa.binary())]

        return work

    return _add(df, ids, {out: BinaryType()}, make)
