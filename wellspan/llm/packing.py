"""Best-fit packing by hierarchical residual packing.

Texts become pieces of at most ``capacity`` tokens. Every partition packs its own pieces best-fit
decreasing. Bins that are nearly full leave; the underfull ones go up a tree: bins of ``fan_in``
partitions meet and are packed again as items, until one level has a single partition. At each level at
most ``residual`` bins per partition, those with the most room, go on; fuller ones leave as they are,
so that a task of the next level holds ``fan_in * residual`` items however large the input is. A bin
carries its pieces, at most ``capacity`` of them.

Null texts count as empty; an empty text is one piece that holds the end mark only. Repeated rows,
also of one id, are packed one by one.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wellspan.llm.common import LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES, Memo, is_latin, map_batches, table, texts
from wellspan.session import materialize

# the word pattern of the tokenizer with its classes spelled out for texts of Latin-1 code points
LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+")


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    letters = {b: chr(b) for b in shown}
    return [letters.get(b) or chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids of texts under a lower-casing word-level BPE file of the ``tokenizers`` library.

    Its words are independent of each other. Texts of Latin-1 code points are cut into words here and
    each word's ids, which the library's model gives, are remembered; all other texts, whose
    normalisation is the library's business, and those that contain one of the file's added tokens go
    through the library whole.
    """

    def __init__(self, definition: str, remember: int = 300_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, special))) if special else None
        self.tokenize = self.whole.model.tokenize
        self.letters = byte_letters()
        self.memo = Memo(self._word, remember)

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.tokenize("".join([self.letters[b] for b in word.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if is_latin(text) and not (self.added and self.added.search(text)):
            # lower case of a Latin-1 text stays in Latin-1
            out = b"".join(map(self.memo.__getitem__, LATIN_WORDS.findall(text.lower())))
            self.memo.trim()
            return out
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of each document."""
    with open(path) as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # the tokenizer's file
    end = struct.pack("<I", end_id)
    key_type = docs.schema[key].dataType.simpleString()

    def make():
        if _KEPT.get("path") != path:
            _KEPT.update(path=path, tokenizer=WordTokenizer(sent.value))
        ids_of = _KEPT["tokenizer"].ids

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, t in zip(batch.column(key).to_pylist(), texts(batch, text)):
                packed = ids_of(t) + end
                for n, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at:at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [batch.column(key).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              [key, "piece", "start", "length", "ids_crc32"])

        return step

    return map_batches(docs.select(key, text), make, PIECES.replace("doc_id bigint", f"{key} {key_type}"))


_KEPT: dict = {}


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still has room for it."""
    open_room: list[int] = []  # ascending, without repeats
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        at = bisect.bisect_left(open_room, size)
        if at < len(open_room):
            room = open_room[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                open_room.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(open_room, room)
            by_room[room].append(b)
    return bins


CONTENT = ("doc", "piece", "start", "length", "ids_crc32", "offset")
BINS = "g bigint, local bigint, final boolean, used bigint, content array<struct<" + ", ".join(f"{c}: bigint" for c in CONTENT) + ">>"
_CONTENT = pa.list_(pa.struct([(c, pa.int64()) for c in CONTENT]))


def pack_group(items: list[tuple[int, list[dict]]], capacity: int, nearly: float, residual: int, last: bool):
    """(final, used, content) of each bin that the items, bins of an earlier level or pieces, are packed in."""
    items.sort(key=lambda x: (-x[0], x[1][0]["doc"] is None, x[1][0]["doc"] or 0, x[1][0]["piece"]))
    bins = []
    for own in best_fit([used for used, _ in items], capacity):
        content, at = [], 0
        for i in own:
            for piece in items[i][1]:
                content.append(piece | {"offset": at})
                at += piece["length"]
        bins.append((at, content))
    bins.sort(key=lambda b: b[0])  # those with the most room first
    for n, (used, content) in enumerate(bins):
        yield last or used >= nearly * capacity or n >= residual, used, content


def _pack_level(level: DataFrame, capacity: int, nearly: float, residual: int, last: bool) -> DataFrame:
    """Pack each group ``g`` of bins on its own, in the task that holds it."""

    def run(batches):
        groups: dict[int, list] = {}
        for batch in batches:
            for g, used, content in zip(*(batch.column(c).to_pylist() for c in ("g", "used", "content"))):
                groups.setdefault(g, []).append((used, content))
        for g in sorted(groups):
            found = list(pack_group(groups.pop(g), capacity, nearly, residual, last))
            for at in range(0, len(found), 1000):
                part = found[at:at + 1000]
                final, used, content = zip(*part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(final),
                     pa.array(used, pa.int64()), pa.array(content, _CONTENT)], ["g", "local", "final", "used", "content"])

    return level.mapInArrow(run, BINS)


def pack(found: DataFrame, key: str = "doc_id", capacity: int = 4096, nearly: float = 0.995, fan_in: int = 8,
         residual: int = 4000, leaf_rows: int = 20_000) -> DataFrame:
    """``found`` (pieces, as :func:`pieces` gives them, of a written table) plus ``sequence_id`` and ``offset``.

    A group of the first level has about ``leaf_rows`` pieces, dealt evenly whatever their keys are.
    """
    kinds = {c: found.schema[c].dataType for c in (key, "piece")}
    width = max(1, -(-found.count() // leaf_rows))
    piece = F.struct(*[F.col(key if c == "doc" else c).cast("bigint").alias(c) for c in CONTENT[:-1]], F.lit(0).cast("bigint").alias("offset"))
    level = found.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(width)).alias("g"),
                         F.col("length").alias("used"), F.array(piece).alias("content"))
    done, height = [], 0
    while True:
        packed = materialize(_pack_level(level.repartition(width, "g"), capacity, nearly, residual, width == 1), "packing")
        done.append(packed.where("final").withColumn("height", F.lit(height)))
        if width == 1:
            break
        width, height = -(-width // fan_in), height + 1
        level = packed.where("NOT final").select(F.floor(F.col("g") / F.lit(fan_in)).alias("g"), "used", "content")
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    number = F.shiftleft(F.col("height").cast("bigint"), 58) + F.shiftleft("g", 26) + F.col("local")
    return bins.select(number.alias("sequence_id"), F.inline("content")).select(
        F.col("doc").cast(kinds[key]).alias(key), F.col("piece").cast(kinds["piece"]).alias("piece"),
        "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize once, then pack."""
    return pack(materialize(pieces(docs, path, end_id, capacity, key, text), "pieces"), key, capacity)


def op10_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
