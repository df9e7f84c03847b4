"""Exact Jaccard join of word shingles with a token-group matrix.

A document is the set of its distinct word shingles, each a 64-bit hash (a *token*). Two documents link
if ``100 * intersection >= 80 * union``. All links count; only components are returned, so links inside
one component need not be listed.

1. *Shared tokens.* Tokens meet by value. A document fewer than 80 % of whose tokens occur in another
   document can't link with any, and most leave here. A token that is found twice in one chunk of input
   is known to be shared on the spot and sends a marker only, so that a passage in a third of all
   documents costs a few rows a task. Equal sets become one class.
2. *Groups.* The classes left are partitioned by a min-hash, twice with different seeds; a part is dealt
   into groups of about ``GROUP`` members. Links inside a group are found by exact intersection.
3. *Token-group matrix.* Each group (its members of one component) stores the union of its tokens. Of a
   group's union, the tokens that occur in a group of another component bound the overlap of any member
   with any document outside. Groups whose bound can't reach 80 % of their smallest member stay closed.
4. *Opened groups.* Members of the others are grouped anew, small components by min-hash. Two of these
   groups are opened for each other if their members' prefixes (rarest tokens, as many as no link can do
   without) share a token. Each member is bounded against the other group's union, then compared exactly.

The matrix is sent between tasks as packed blocks, a few bytes a token; nothing is collected to the
driver, and no step lists the pairs of a group of copies.

Null texts and texts without words have no tokens and link with nothing. Rows that share a key are one
document for links (those of its texts all count); a row without key gets no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wellspan.llm.common import Memo, gram_hashes, map_batches, mix, table, word_hashes
from wellspan.session import materialize

SHINGLE = 5
PERCENT = 80
GROUP = 64
CHUNK = 3_000_000  # tokens that a mapper sorts at a time
MARKER = np.iinfo(np.int64).min  # instead of an owner: the token is shared
BITS = 48  # of a token, in step 1 and 3: a collision only lets a document stay


def tokens_of(data: bytes, memo: Memo, k: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of a UTF-8 text, ascending."""
    return np.unique(gram_hashes(word_hashes(memo, data.lower().split()), k))


def needed(n):
    """Least overlap with any set that a set of ``n`` tokens needs to link."""
    return -(-PERCENT * n // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


# --- packed numbers ----------------------------------------------------------------------

def pack(a: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: planes that hold little cost little."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


# --- tokens meet by value ----------------------------------------------------------------

BLOCK = "p int, kind int, a binary, b binary, c binary"
_BLOCK = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _send(owners: list[int], worlds: list[int], sets: list[np.ndarray], parts: int, whole: bool) -> Iterator[tuple]:
    """Rows (p, kind, a, b, c) for one chunk of sets. kind 0: token deltas, owner, world; kind 1: owner, count.

    ``worlds``: a token counts as shared if it occurs in two worlds (documents, or components). With ``whole``
    all postings are sent, none is counted here.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    t = np.concatenate(sets) >> np.uint64(64 - BITS)
    at = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(t)
    t, at = t[order], at[order]
    owner, world = np.array(owners, np.int64), np.array(worlds, np.int64)
    w = world[at]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    sizes = np.diff(np.append(first, len(t)))
    mixed = np.add.reduceat((w != np.repeat(w[first], sizes)).astype(np.int64), first) > 0
    mixed &= not whole
    in_mixed = np.repeat(mixed, sizes)
    counts = np.bincount(at[in_mixed], minlength=len(sets))
    some = np.flatnonzero(counts)
    if len(some):
        yield int(t[0]) % parts, 1, pack(owner[some]), pack(counts[some].astype(np.int64)), b""
    keep = ~in_mixed
    keep[first[mixed]] = True  # one row stands for all of a token known to be shared
    o = np.where(in_mixed, MARKER, owner[at])[keep]
    w = np.where(in_mixed, MARKER, w)[keep]
    t = t[keep]
    edges = np.searchsorted(t, (np.arange(1, parts, dtype=np.uint64) << np.uint64(BITS)) // np.uint64(parts))
    edges = np.concatenate([[0], edges, [len(t)]])
    same = worlds is owners
    for p in range(parts):
        s = slice(edges[p], edges[p + 1])
        if s.stop > s.start:
            yield p, 0, pack(np.diff(t[s], prepend=np.uint64(0))), pack(o[s]), b"" if same else pack(w[s])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCK)], schema=_BLOCK)


def _receive(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Owners and how many of their tokens in this part are shared."""
    owners, counts, t, o, w = [], [], [], [], []
    for kind, a, b, c in zip(*(found.column(n).to_pylist() for n in ("kind", "a", "b", "c"))):
        if kind == 1:
            owners.append(unpack(a))
            counts.append(unpack(b))
        else:
            t.append(np.cumsum(unpack(a, np.uint64)))
            o.append(unpack(b))
            w.append(unpack(c) if c else o[-1])
    if t:
        t, o, w = np.concatenate(t), np.concatenate(o), np.concatenate(w)
        order = np.argsort(t)
        t, o, w = t[order], o[order], w[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        sizes = np.diff(np.append(first, len(t)))
        shared = np.add.reduceat(((w != np.repeat(w[first], sizes)) | (o == MARKER)).astype(np.int64), first) > 0
        o = o[np.repeat(shared, sizes)]
        o = o[o != MARKER]
        owners.append(o)
        counts.append(np.ones(len(o), np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, back = np.unique(np.concatenate(owners), return_inverse=True)
    return who, np.bincount(back, np.concatenate(counts), len(who)).astype(np.int64)


def _blocks(units: Iterator[tuple[int, int, np.ndarray, tuple]], parts: int, facts: bool, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """``units``: owner, world (None: the owner), tokens, and (n, two halves of a digest) if ``facts``."""
    owners, worlds, sets, more, size = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        rows = []
        if facts:
            rows.append((abs(owners[0]) % parts, 2, pack(np.array(owners, np.int64)), pack(np.array(more, np.int64).reshape(-1)), b""))
        full = [i for i, s in enumerate(sets) if len(s)]
        if full:
            o = [owners[i] for i in full]
            w = o if worlds[0] is None else [worlds[i] for i in full]
            rows += _send(o, w, [sets[i] for i in full], parts, whole)
        for x in (owners, worlds, sets, more):
            x.clear()
        return _batch(rows)

    for owner, world, tokens, extra in units:
        owners.append(owner)
        worlds.append(world)
        sets.append(tokens)
        more.append(extra)
        size += len(tokens) + 1
        if size >= CHUNK:
            yield flush()
            size = 0
    if owners:
        yield flush()


def digest(tokens: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    a, b = np.frombuffer(xxh3_128_digest(tokens.tobytes()), np.int64)
    return int(a), int(b)


def _parts(df: DataFrame) -> int:
    return min(60_000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows whose first ``keys`` columns are equal. Only one run is in memory."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _as_tokens(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys next to each other in one task, however many keys a task gets."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


# --- step 1 ------------------------------------------------------------------------------

def _facts(docs: DataFrame, k: int) -> DataFrame:
    """Rows (id, n, d1, d2) for each document, and rows (q, a, b) of packed ids and partial counts of shared tokens."""
    parts = _parts(docs)
    back = max(1, parts // 8)

    def send(batches):
        from xxhash import xxh3_64_intdigest

        memo = Memo(xxh3_64_intdigest)

        def units():
            for batch in batches:
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    tokens = tokens_of(text or b"", memo, k)
                    memo.trim()
                    yield i, None, tokens, (len(tokens), *digest(tokens))

        yield from _blocks(units(), parts, True)

    out = pa.schema([*[(c, pa.int64()) for c in ("id", "n", "d1", "d2")], ("q", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def receive(found: pa.Table) -> pa.Table:
        kinds = np.array(found.column("kind").to_pylist())
        who, counts = _receive(found.filter(pa.array(kinds != 2)))
        own = found.filter(pa.array(kinds == 2))
        ids = [unpack(a) for a in own.column("a").to_pylist()]
        more = [unpack(b).reshape(-1, 3) for b in own.column("b").to_pylist()]
        ids = np.concatenate([np.zeros(0, np.int64), *ids])
        more = np.concatenate([np.zeros((0, 3), np.int64), *more])
        q = (mix(who.view(np.uint64)) % np.uint64(back)).astype(np.int64)
        packed = [(int(k), pack(who[q == k]), pack(counts[q == k])) for k in np.unique(q)]
        none = pa.nulls(len(packed), pa.int64())
        return pa.concat_tables([
            pa.table([pa.array(ids), *[pa.array(more[:, j]) for j in range(3)], *[pa.nulls(len(ids), f.type) for f in list(out)[4:]]], schema=out),
            pa.table([none] * 4 + [pa.array(c, f.type) for c, f in zip(zip(*packed) if packed else ((), (), ()), list(out)[4:])], schema=out)])

    return docs.mapInArrow(send, BLOCK).groupBy("p").applyInArrow(
        receive, "id bigint, n bigint, d1 bigint, d2 bigint, q int, a binary, b binary")


def _shared(found: DataFrame) -> DataFrame:
    """(id, c): how many of a document's tokens another one has, from the packed partial counts."""
    def total(part: pa.Table) -> pa.Table:
        ids, counts = (np.concatenate([unpack(x) for x in part.column(c).to_pylist()]) for c in ("a", "b"))
        who, back = np.unique(ids, return_inverse=True)
        return pa.table([pa.array(who), pa.array(np.bincount(back, counts, len(who)).astype(np.int64))], names=["id", "c"])

    return found.where("q IS NOT NULL").select("q", "a", "b").groupBy("q").applyInArrow(total, "id bigint, c bigint")


# --- step 2 ------------------------------------------------------------------------------

def min_hash(tokens: np.ndarray, seed: int) -> int:
    return int(mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * seed & (1 << 64) - 1)).min().view(np.int64))


SETS = "id bigint, n bigint, g1 bigint, g2 bigint, tokens binary"


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Token sets of the wanted (id, n, d1, d2)."""
    def run(batches):
        from xxhash import xxh3_64_intdigest

        memo = Memo(xxh3_64_intdigest)
        for batch in batches:
            rows = []
            for i, n, d1, d2, text in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "d1", "d2", "text"))):
                tokens = tokens_of(text.encode(), memo, k)
                if len(tokens) == n and digest(tokens) == (d1, d2):
                    rows.append((i, n, min_hash(tokens, 1), min_hash(tokens, 2), tokens.tobytes()))
                memo.trim()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])], ["id", "n", "g1", "g2", "tokens"])

    return docs.join(wanted, "id").select("id", "n", "d1", "d2", "text").mapInArrow(run, SETS)


def _dealt(df: DataFrame, group: str) -> DataFrame:
    """``df`` plus ``block``, by which a group of more than ``GROUP`` rows is dealt into parts of about that size."""
    large = df.groupBy(group).count().where(F.col("count") > GROUP)
    return df.join(large, group, "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / F.lit(GROUP))), F.lit(0)).cast("bigint")).drop("count")


def link_group(members: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges (id, smallest id) that connect what the links among ``members`` connect."""
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    members = sorted(members, key=lambda m: m[0])
    for i in range(len(members)):
        for j in range(i):
            a, b = find(i), find(j)
            if a != b and linked(members[i][1], members[j][1]):
                root[max(a, b)] = min(a, b)
    return [(members[i][0], members[find(i)][0]) for i in range(len(members)) if members[find(i)][0] != members[i][0]]


def _links_inside(sets: DataFrame, group: str) -> DataFrame:
    def run(batches):
        for _, rows in _runs(batches, 2):
            if len(rows) > 1:
                edges = link_group([(i, _as_tokens(t)) for i, t in rows])
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["u", "v"])

    return _together(_dealt(sets.select(group, "id", "tokens"), group).select(group, "block", "id", "tokens"),
                     group, "block").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all vertices but the roots; a root is the smallest vertex of its component.

    Large-star and small-star steps by turns, each a join with one row per vertex.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state == was or not state[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        was = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = materialize(small.select("u", F.col("m").alias("v")).unionByName(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "edges")


# --- steps 3 and 4 -----------------------------------------------------------------------

def _open_groups(sets: DataFrame) -> DataFrame:
    """Groups (gid) of members (gid, world, id, n, tokens) that may link with a document of another world."""
    parts = _parts(sets)

    def send(batches):
        def units():
            for (gid, world), rows in _runs(batches, 2):
                sets_ = [_as_tokens(t) for t, in rows]
                yield gid, world, sets_[0] if len(sets_) == 1 else np.unique(np.concatenate(sets_)), ()

        yield from _blocks(units(), parts, False)

    def receive(found: pa.Table) -> pa.Table:
        who, counts = _receive(found)
        return pa.table([pa.array(who), pa.array(counts)], names=["gid", "c"])

    bound = _together(sets.select("gid", "world", "tokens"), "gid", "world").mapInArrow(send, BLOCK).groupBy("p").applyInArrow(
        receive, "gid bigint, c bigint").groupBy("gid").agg(F.sum("c").alias("c"))
    least = sets.groupBy("gid").agg(F.min("n").alias("n"))
    return bound.join(least, "gid").where(F.col("c") * 100 >= F.col("n") * PERCENT).select("gid")


def _prefixes(members: DataFrame) -> DataFrame:
    """(id, prefix): each member's rarest tokens, as many as make it impossible to link without sharing one.

    The order is by how many members have a token, then by token. Tokens of one member only come first
    and can't be shared, so they aren't listed; a member that then has too few tokens left goes.
    """
    parts = _parts(members)
    back = max(1, parts // 8)

    def send(batches):
        def units():
            for batch in batches:
                for i, n, t in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "tokens"))):
                    yield i, n, _as_tokens(t), ()

        yield from _blocks(units(), parts, False, whole=True)

    def count(found: pa.Table) -> pa.Table:
        t = np.concatenate([np.cumsum(unpack(a, np.uint64)) for a in found.column("a").to_pylist()])
        o, n = (np.concatenate([unpack(x) for x in found.column(c).to_pylist()]) for c in ("b", "c"))
        order = np.argsort(t)
        t, o, n = t[order], o[order], n[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        df = np.repeat(sizes := np.diff(np.append(first, len(t))), sizes)
        t, o, n, df = (x[df > 1] for x in (t, o, n, df))
        q = (mix(o.view(np.uint64)) % np.uint64(back)).astype(np.int64)
        rows = [(int(k), 0, pack(o[q == k]), pack(t[q == k]), pack(df[q == k] << 32 | n[q == k])) for k in np.unique(q)]
        return pa.Table.from_batches([_batch(rows)] if rows else [], schema=_BLOCK)

    def choose(found: pa.Table) -> pa.Table:
        o, t, x = (np.concatenate([unpack(v) for v in found.column(c).to_pylist()]) for c in ("a", "b", "c"))
        order = np.lexsort((t, x >> 32, o))
        o, t, n = o[order], t[order], (x & 0xFFFFFFFF)[order]
        first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        c = np.diff(np.append(first, len(o)))
        take = c - needed(n[first]) + 1
        kept = [(int(o[f]), t[f:f + k].tobytes()) for f, k in zip(first.tolist(), take.tolist()) if k > 0]
        ids, prefix = zip(*kept) if kept else ((), ())
        return pa.table([pa.array(ids, pa.int64()), pa.array(prefix, pa.binary())], names=["id", "prefix"])

    return members.mapInArrow(send, BLOCK).groupBy("p").applyInArrow(count, BLOCK).groupBy("p").applyInArrow(choose, "id bigint, prefix binary")


def _regrouped(members: DataFrame) -> DataFrame:
    """Members in groups of about ``GROUP``: those of a large world together, all others by min-hash."""
    large = members.groupBy("world").count().where(F.col("count") >= GROUP // 2).select("world", F.lit(True).alias("large"))
    keyed = members.join(large, "world", "left").withColumn("key", F.when(F.col("large"), F.xxhash64("world")).otherwise(F.col("g1")))
    return _dealt(keyed.select("key", "world", "id", "tokens", "prefix"), "key").select(
        F.xxhash64("key", "block").alias("gid"), "world", "id", "tokens", "prefix")


GROUPS = "gid bigint, lo bigint, hi bigint, least bigint, most bigint, ids binary, worlds binary, sizes binary, tokens binary, prefix binary"
_GROUPS = pa.schema([*[(c, pa.int64()) for c in ("gid", "lo", "hi", "least", "most")], *[(c, pa.binary()) for c in ("ids", "worlds", "sizes", "tokens", "prefix")]])


def _packed_groups(members: DataFrame) -> DataFrame:
    """One row per group: its members' ids, worlds, sizes and tokens one after the other, and the union of their prefixes."""
    def run(batches):
        for (gid,), rows in _runs(batches, 1):
            worlds, ids = (np.array([r[c] for r in rows], np.int64) for c in (0, 1))
            sizes = np.array([len(r[2]) // 8 for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (gid, worlds.min(), worlds.max(), sizes.min(), sizes.max(), ids.tobytes(), worlds.tobytes(), sizes.tobytes(), b"".join(r[2] for r in rows),
                 np.unique(np.frombuffer(b"".join(r[3] for r in rows), np.int64)).tobytes()),
                _GROUPS)], schema=_GROUPS)

    return _together(members, "gid").mapInArrow(run, GROUPS)


def _group_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): pairs of groups, a < b, the unions of whose prefixes share a token."""
    parts = _parts(groups)

    def send(batches):
        def units():
            for batch in batches:
                for gid, t in zip(batch.column("gid").to_pylist(), batch.column("prefix").to_pylist()):
                    # prefixes hold the upper bits only; _send cuts tokens to those
                    yield gid, None, np.frombuffer(t, np.uint64) << np.uint64(64 - BITS), ()

        yield from _blocks(units(), parts, False, whole=True)

    def receive(found: pa.Table) -> pa.Table:
        t = np.concatenate([np.cumsum(unpack(a, np.uint64)) for a in found.column("a").to_pylist()])
        gids, g = np.unique(np.concatenate([unpack(b) for b in found.column("b").to_pylist()]), return_inverse=True)
        order = np.lexsort((g, t))
        t, g = t[order], g[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        sizes = np.diff(np.append(first, len(t)))
        codes = [np.zeros(0, np.int64)]
        for size in np.unique(sizes[sizes > 1]):
            starts = first[sizes == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, 2_000_000 // len(i))
            for at in range(0, len(starts), step):
                rows = g[starts[at:at + step, None] + np.arange(size)]
                codes.append(np.unique(rows[:, i].astype(np.int64) * len(gids) + rows[:, j]))
        code = np.unique(np.concatenate(codes))
        return pa.table([pa.array(gids[code // len(gids)]), pa.array(gids[code % len(gids)])], names=["a", "b"])

    return groups.select("gid", "prefix").mapInArrow(send, BLOCK).groupBy("p").applyInArrow(receive, "a bigint, b bigint").distinct()


def spanning(edges) -> list[tuple[int, int]]:
    """As many of the edges as connect the same vertices."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def open_group(queries: list[np.ndarray], group: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (query, member) by number. A query whose overlap with the group's union is too small is not compared."""
    tokens = np.concatenate(group)
    member = np.repeat(np.arange(len(group)), [len(m) for m in group])
    order = np.argsort(tokens)
    tokens, member = tokens[order], member[order]
    sizes = np.array([len(m) for m in group], np.int64)
    out = []
    for q, own in enumerate(queries):
        low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        n = high - low
        if (n > 0).sum() < needed(len(own)):
            continue
        at = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(member[at], minlength=len(group))
        out += [(q, int(m)) for m in np.flatnonzero(100 * both >= PERCENT * (len(own) + sizes - both))]
    return out


def _links_across(members: DataFrame) -> DataFrame:
    """Edges between worlds of members (world, id, n, g1, tokens) that link."""
    prefixes = materialize(_prefixes(members), "prefixes")
    groups = materialize(_packed_groups(_regrouped(members.join(prefixes, "id"))), "groups")
    facts = groups.select("gid", "lo", "hi", "least", "most")
    a, b = (facts.select(*[F.col(c).alias(f"{side}_{c}") for c in facts.columns]) for side in "ab")
    able = (
        (F.col("a_most") * 100 >= F.col("b_least") * PERCENT) & (F.col("b_most") * 100 >= F.col("a_least") * PERCENT)
        & ((F.col("a_lo") != F.col("a_hi")) | (F.col("b_lo") != F.col("b_hi")) | (F.col("a_lo") != F.col("b_lo"))))
    pairs = _group_pairs(groups).join(a, F.col("a") == F.col("a_gid")).join(b, F.col("b") == F.col("b_gid")).where(able).select("a", "b")
    inside = facts.where("lo <> hi").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    whole = ("worlds", "sizes", "tokens")
    sides = [groups.select(F.col("gid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in whole]) for side in "ab"]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    opened = materialize(pairs.unionByName(inside), "pairs").repartition(n, F.xxhash64("a", "b"))
    opened = opened.join(sides[0], "a").join(sides[1], "b").select(*[f"{side}_{c}" for side in "ab" for c in whole])

    def verify(batches):
        def read(row):
            worlds, sizes = (np.frombuffer(x, np.int64) for x in row[:2])
            return worlds, np.split(_as_tokens(row[2]), np.cumsum(sizes)[:-1])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                (worlds, sets), (other_worlds, others) = read(row[:3]), read(row[3:])
                edges = spanning((int(worlds[q]), int(other_worlds[m])) for q, m in open_group(sets, others))
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["u", "v"])

    return opened.mapInArrow(verify, "u bigint, v bigint")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id) of each row; the component is its smallest key."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    found = materialize(_facts(rows.where("id IS NOT NULL"), k), "facts")
    facts = found.where("n IS NOT NULL").select("id", "n", "d1", "d2")
    shared = _shared(found)
    classes = facts.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    same = facts.join(classes.where("rep <> last"), ["n", "d1", "d2"]).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    wanted = classes.select(F.col("rep").alias("id"), "n", "d1", "d2").join(shared, "id").where(
        F.col("c") * 100 >= F.col("n") * PERCENT).select("id", "n", "d1", "d2")
    sets = materialize(_sets(rows.where("text IS NOT NULL"), wanted, k), "sets")
    edges = materialize(same.unionByName(_links_inside(sets, "g1")).unionByName(_links_inside(sets, "g2")), "links")
    roots = components(edges)
    placed = sets.select("id", "n", "g1", "tokens").join(roots, "id", "left").select(
        F.coalesce("root", "id").alias("world"), "id", "n", "g1", "tokens")
    members = _dealt(placed, "world").select(F.xxhash64("world", "block").alias("gid"), "world", "id", "n", "g1", "tokens")
    opened = materialize(members.join(_open_groups(members), "gid", "left_semi"), "opened")
    if not opened.isEmpty():
        # worlds that link become one; a world is named by its smallest id
        merged = components(_links_across(opened.select("world", "id", "n", "g1", "tokens"))).select(
            F.col("id").alias("world"), F.col("root").alias("final"))
    else:
        merged = roots.limit(0).select(F.col("id").alias("world"), F.col("root").alias("final"))
    placed = facts.select("id", "n").join(roots, "id", "left").withColumn("world", F.coalesce("root", "id"))
    out = placed.join(merged, "world", "left").select(
        F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("final", "world").alias("component_id"))
    return out.unionByName(_without_key(rows, k).select(F.lit(None).cast(kind).alias(key), "n_shingles", "component_id"))


def _without_key(rows: DataFrame, k: int) -> DataFrame:
    def make():
        from xxhash import xxh3_64_intdigest

        memo = Memo(xxh3_64_intdigest)

        def step(batch):
            n = [len(tokens_of((t or "").encode(), memo, k)) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["n_shingles", "component_id"])

        return step

    return map_batches(rows.where("id IS NULL"), make, "n_shingles bigint, component_id bigint")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the rows of its smallest key; rows without key stay."""
    gone = join(docs, key, text).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(gone, key, "left_anti").select(*docs.columns)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
