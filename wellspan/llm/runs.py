"""Runs of repeated words in texts, found with longest common extensions.

A run is a stretch of consecutive words with smallest period ``q``, of at least ``max(LEAST, EXPONENT * q)``
words, that can't be made longer on either side with that period. They are found in three steps.

1. *Longest common extensions.* The texts of a batch are laid end to end as word numbers, each between marks
   that occur once, so that no match leaves its text. Only suffixes at positions of a difference cover modulo
   ``V`` are sorted: first by their next words, then by doubling, since a position and the one ``V`` words on
   are both in the cover or both not. For any two positions the cover has an offset below ``V`` that takes
   both into it; fewer than ``V`` words are compared, and a sparse table of minima over the common prefixes
   of neighbours in sorted order gives the rest. The same is built over the words in reverse.
2. *Harmonic grid.* A run with period ``p`` has ``EXPONENT - 1`` times ``p`` places or more whose word recurs
   ``p`` words on, so one of them is a multiple of ``(EXPONENT - 1) * p``. Extending each such pair both ways
   finds all runs; the grid has about ``n * ln(n) / (EXPONENT - 1)`` pairs.
3. A stretch that several periods describe is one run, with the smallest.

Texts are read whole, and each is dealt with by one task. Work is ``n log n`` for any text, memory some dozen
numbers a word of a batch; the grid is read in blocks. A null or blank text has no words and no runs; a null
key is not edited by :func:`edited`. Repeated rows are answered alike, empty tables give no rows, and of other
columns none is read, whatever their names.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wellspan.llm.common import WORD, map_batches, table

# fixed values: a perfect difference set; every number from 1 to 30 is a difference of two members modulo 31
V, COVER = 31, (0, 1, 3, 8, 12, 18)
LEAST, EXPONENT = 6, 4
PACK = 3  # word numbers in one sorting key, fewer if they don't fit
BATCH_WORDS = 1 << 18
GRID_BLOCK = 1 << 20


def _shifts() -> np.ndarray:
    """For two remainders modulo V the least step that takes both into the cover."""
    inside = np.isin(np.arange(V), COVER)
    out = np.full((V, V), V, np.int64)
    for step in range(V - 1, -1, -1):
        both = np.outer(inside[(np.arange(V) + step) % V], inside[(np.arange(V) + step) % V])
        out[both] = step
    return out


_SHIFT = _shifts()
_PLACE = np.full(V, -1, np.int64)
_PLACE[list(COVER)] = np.arange(len(COVER))


def _slot(at: np.ndarray) -> np.ndarray:
    """Number of a cover position among the cover positions."""
    return at // V * len(COVER) + _PLACE[at % V]


class Extensions:
    """Lengths of common extensions of any two positions of ``words``, positive numbers.

    Of two different positions one must reach a number that occurs once before the end.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * V + PACK, np.int64)])
        at = np.arange(n)
        at = at[_PLACE[at % V] >= 0]
        order, levels = self._sorted(at)
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        self.minima = self._table(self._neighbours(at[order], levels))

    def _sorted(self, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Cover positions in suffix order, and their ranks by prefixes of ``V`` words and more, by length."""
        w, m = self.words, len(at)
        bits = int(w.max()).bit_length()
        pack = max(1, min(PACK, 63 // bits))
        order, head = np.arange(m), np.zeros(m, np.int64)
        tied = np.arange(m)

        def refine(tied: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Sort the tied places by ``key`` inside their groups; the places that are still tied."""
            by = np.lexsort((key, head[tied]))
            order[tied] = order[tied][by]
            key, group = key[by], head[tied]
            new = np.ones(len(tied), bool)
            new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
            head[tied] = np.maximum.accumulate(np.where(new, tied, 0))
            alone = new.copy()
            alone[:-1] &= new[1:]
            return tied[~alone]

        depth = 0
        while depth < V and len(tied):
            p = at[order[tied]] + depth
            key = w[p]
            for k in range(1, pack):
                key = (key << bits) | w[p + k]
            tied = refine(tied, key)
            depth += pack
        levels = []
        while len(tied):
            rank = np.empty(m, np.int64)
            rank[order] = head
            levels.append((depth, rank))
            step = depth // V * V
            # equal for ``depth`` words, so both go on in their texts
            tied = refine(tied, rank[_slot(at[order[tied]] + step)])
            depth += step
        return order, levels

    def _neighbours(self, at: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Common prefixes of suffixes next to each other in sorted order."""
        a, b = at[:-1].copy(), at[1:].copy()
        length = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        if levels:  # only what is tied at the first level has ``V`` words in common
            first = levels[0][1]
            going = going[first[_slot(a)] == first[_slot(b)]]
        for depth, rank in reversed(levels):
            x = length[going]
            same = going[rank[_slot(a[going] + x)] == rank[_slot(b[going] + x)]]
            length[same] += depth // V * V
        return length + self._compare(a + length, b + length, np.full(len(a), 2 * V))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, counted up to ``most``."""
        length = np.zeros(len(i), np.int64)
        going = np.flatnonzero(most > 0)
        step = 0
        while len(going):
            going = going[self.words[i[going] + step] == self.words[j[going] + step]]
            step += 1
            length[going] = step
            going = going[most[going] > step]
        return length

    @staticmethod
    def _table(values: np.ndarray) -> list[np.ndarray]:
        """Minima of windows of 1, 2, 4, ... values."""
        out, width = [values], 1
        while 2 * width <= len(values):
            out.append(np.minimum(out[-1][:-width], out[-1][width:]))
            width *= 2
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers of equal words from ``i`` and from ``j`` on, ``i`` and ``j`` different."""
        shift = _SHIFT[i % V, j % V]
        length = self._compare(i, j, shift)
        on = np.flatnonzero(length == shift)
        if len(on):
            x, y = self.rank[_slot(i[on] + shift[on])], self.rank[_slot(j[on] + shift[on])]
            low, high = np.minimum(x, y), np.maximum(x, y)
            log = np.frexp((high - low).astype(float))[1] - 1
            for k in np.unique(log):
                mine = log == k
                row = self.minima[k]
                length[on[mine]] += np.minimum(row[low[mine]], row[high[mine] - (1 << int(k))])
        return length


def _grid(starts: np.ndarray, sizes: np.ndarray):
    """Blocks of (position, period) for all texts; ``starts`` are the places of their first words."""
    top = sizes // EXPONENT
    owner = np.repeat(np.arange(len(sizes)), top)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(top) - top, top) + 1
    count = (sizes[owner] - 1 - period) // ((EXPONENT - 1) * period) + 1
    ends = np.cumsum(count)
    begin = 0
    while begin < len(owner):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + GRID_BLOCK, "right")))
        c = count[begin:end]
        p = np.repeat(period[begin:end], c)
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(starts[owner[begin:end]], c) + k * (EXPONENT - 1) * p, p
        begin = end


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers (1 and up) the rows (start, length, period) of its runs, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not (sizes >= LEAST).any():
        return [np.empty((0, 3), np.int64) for _ in texts]
    mark = max(int(t.max()) for t in texts if len(t)) + 1
    parts: list[np.ndarray] = []
    for k, t in enumerate(texts):
        parts += [np.array([mark + k]), t]
    words = np.concatenate([*parts, [mark + len(texts)]]).astype(np.int64)
    n, starts = len(words), np.cumsum(sizes + 1) - sizes
    ahead, behind = Extensions(words), Extensions(words[::-1].copy())
    found = []
    for i, p in _grid(starts, np.where(sizes >= LEAST, sizes, 0)):
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        forward = ahead(i, i + p)
        back = behind(n - i, n - i - p)
        length = forward + back + p
        good = length >= np.maximum(LEAST, EXPONENT * p)
        found.append(np.stack([i[good] - back[good], length[good], p[good]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of one stretch the smallest period
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, 0] -= starts[owner]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


def longest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; of equal ones the first, then that with the smallest period."""
    if not len(runs):
        return None
    near = runs[:, 1] / runs[:, 2]
    rows = runs[near >= near.max() * (1 - 1e-9)].tolist()
    return tuple(min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [w for w, inside in zip(words, np.cumsum(change)) if not inside]


def edited(words: list[str], doc_id: int | None) -> list[str]:
    """The words of one document in ten made periodic from some place on, by the check sum of its id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * ((n - a) // len(tail) + 1))[:n - a]


def _groups(documents: list[list[str]], most: int):
    """Consecutive documents of at most ``most`` words together; a longer one is alone."""
    group, size = [], 0
    for d in documents:
        if group and size + len(d) > most:
            yield group
            group, size = [], 0
        group.append(d)
        size += len(d)
    if group:
        yield group


def with_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", edit: bool = False) -> DataFrame:
    """``doc_id``, ``runs`` (array of start, length, period) and ``collapsed`` (the kept words) of each row.

    ``edit`` makes one document in ten periodic first, see :func:`edited`. Runs come by start, then period.
    ``best`` is the run with the greatest exponent.
    """
    def start():
        def one(group: list[list[str]]) -> list[np.ndarray]:
            number: dict[str, int] = {}
            return find_runs([np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.int64, len(words)) for words in group])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0).to_pylist()
            documents = (WORD.findall(t.as_py() or "") for t in batch.column(1))
            documents = [edited(d, key) if edit else d for d, key in zip(documents, ids)]
            runs = [r for group in _groups(documents, BATCH_WORDS) for r in one(group)]
            best = [longest(r) for r in runs]
            names = ("start", "length", "period")
            rows = [[dict(zip(names, r)) for r in x.tolist()] for x in runs]
            kept = [" ".join(collapsed(d, r)) for d, r in zip(documents, runs)]
            kind = pa.struct([(c, pa.int64()) for c in names])
            return pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(rows, pa.list_(kind)),
                pa.array([None if b is None else dict(zip(names, b)) for b in best], kind), pa.array(kept, pa.string())],
                ["doc_id", "runs", "best", "collapsed"])

        return step

    run = "struct<start:bigint,length:bigint,period:bigint>"
    kind = df.schema[doc_id].dataType.simpleString()
    return map_batches(df.select(doc_id, text), start, f"doc_id {kind}, runs array<{run}>, best {run}, collapsed string")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = with_runs(table(spark, sf_dir, "documents"), edit=True)
    return found.selectExpr(
        "doc_id", "cast(size(runs) as bigint) AS n_runs", "best.start AS start", "best.length AS length", "best.period AS period",
        "1000 * best.length div best.period AS exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256")
