"""What the text operators share: reading, folds, Arrow batches, Latin-1 token patterns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BATCH_ROWS = 1024

# fixed values: Latin-1 members of \p{L}, \p{N} and \s
LATIN_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
LATIN_SPACES = r"\t-\r \x85\xa0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added, such that ``df`` has no column of it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def fold(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; NULL for NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def spread_key(*columns: str) -> Column:
    """A number from 0 to 2**20 - 1 that depends on the values only."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(1 << 20))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
                schema: StructType | str) -> DataFrame:
    """Run ``make()`` once for each task and its result on every Arrow batch.

    Rows never meet in one place; a lost task is simply run again.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, NULL as the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def is_latin(text: str) -> bool:
    """Whether all code points are below 256, so that the Latin-1 patterns say the same as the Unicode ones."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Memo(dict):
    """Results of ``compute`` by key. :meth:`trim` empties it when it has grown beyond ``most`` entries."""

    def __init__(self, compute: Callable, most: int = 300_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_hashes(memo: Memo, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes; of the whole sequence if it is shorter."""
    k = min(k, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out = mix(out * _MULT + h[i:i + n])
    return out
