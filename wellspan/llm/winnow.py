"""Document fingerprints by winnowing, in DataFrame functions only.

A text is read as its characters without blanks, so that spacing doesn't matter and an edit shifts nothing
but itself. Every ``k`` characters in a row are hashed (a polynomial modulo a prime, put together from parts:
the value a rolling hash has). Of every ``w`` hashes in a row the smallest is chosen, the rightmost of equal
ones, and kept with its position. Any run of ``w + k - 1`` equal characters in two texts, wherever it starts,
therefore gives both a common hash. With ``unit`` above 1 the same holds for units of so many characters,
counted from the start of each word.

A text with fewer than ``k`` units is one gram; a null, empty or blank text has an empty fingerprint.
Equal texts have equal fingerprints. The likeness of two fingerprints is the Jaccard similarity of their
hashes; two empty ones have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.llm.common import free_name, table

UNIT = 1
K = 12
WINDOW = 24
BLANKS = " \t\n\x0b\f\r"  # what \s means
PRIME = (1 << 31) - 1
BASE = 1_000_003
LOW = (1 << 32) - 1


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` written, and computed, once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _nulls(n: int) -> Column:
    return F.array_repeat(F.lit(None).cast("bigint"), n)


def _after(a: Column, places: int) -> Column:
    """``a`` moved on by NULLs in front: a copy of references, while a slice goes from element to element and costs as much as a pass."""
    return F.concat(_nulls(places), a)


def _joined(left: Column, right: Column, gap: int) -> Column:
    """Hashes of runs of units in ``left``, each followed by a run of ``gap`` units in ``right``, at the place where that ends; NULL where there is none."""
    factor = F.lit(pow(BASE, gap, PRIME))
    return F.zip_with(_after(left, gap), right, lambda x, y: (x * factor + y) % F.lit(PRIME))


def _grams(units: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` units, between ``k - 1`` NULLs on each side: runs of powers of two, put together by the binary digits of ``k``. A single unit stays."""

    def step(whole: Column | None, length: int, a: Column, gap: int) -> Column:
        # ``whole`` has the runs of ``length`` units, the digits of k below ``gap``; ``a`` those of ``gap`` units
        def use(a: Column) -> Column:
            if not k & gap:
                return step(whole, length, _joined(a, a, gap), 2 * gap)
            # the longer run goes first
            joined = a if whole is None else _joined(a, whole, length)
            if length + gap == k:
                return joined
            return _let(joined, lambda j: step(j, length + gap, _joined(a, a, gap), 2 * gap))

        return _let(a, use)

    return _let(units, lambda u: F.when(F.size(u) > 1, step(None, 0, u, 1)).otherwise(F.concat(_nulls(k - 1), u, _nulls(k - 1))))


def _least(c: Column, gap: int) -> Column:
    """Minima of windows ``gap`` longer, at their last place; those that begin before the first gram are of what there is (a comparison with NULL isn't true)."""
    return _let(c, lambda a: F.zip_with(_after(a, gap), a, lambda x, y: F.call_function("if", x < y, x, y)))


def _bare(text: Column) -> Column:
    """The text without blanks. Searching for one byte at a time is many times faster than ``translate``."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank))
    return text


def _units(text: Column, unit: int) -> Column:
    if unit > 1:
        return F.regexp_extract_all(text, F.lit(rf"\S{{1,{unit}}}"), F.lit(0))
    return _let(_bare(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "")))


def _minima(text: Column, unit: int = UNIT, k: int = K, w: int = WINDOW) -> Column:
    """The chosen gram of every window in turn, each hash * 2**32 + (2**32 - 1 - position)."""
    units = _units(F.coalesce(text, F.lit("")), unit)
    grams = _let(units, lambda u: F.when(F.size(u).between(1, k - 1), F.array(F.concat_ws(" ", u))).otherwise(u))
    grams = _grams(F.transform(grams, lambda u: F.pmod(F.xxhash64(u), F.lit(PRIME))), k)
    chosen = F.transform(grams, lambda h, i: F.shiftleft(h, 32) + (F.lit(LOW + k - 1) - i))
    length = 1
    while length < w:
        gap = min(length, w - length)  # windows of ``length`` may overlap
        chosen = _least(chosen, gap)
        length += gap

    def whole(c: Column) -> Column:
        n = F.size(c) - (2 * (k - 1) + w - 1)  # grams
        # whole windows only, or the one of all grams
        return F.slice(c, F.greatest(F.least(n, F.lit(w)) + (k - 1), F.lit(1)), F.greatest(n - (w - 1), F.least(n, F.lit(1))))

    return _let(chosen, whole)


def fingerprint(text: str | Column, unit: int = UNIT, k: int = K, w: int = WINDOW) -> Column:
    """Array of chosen grams in order of position, each hash * 2**32 + (2**32 - 1 - position)."""
    return F.array_distinct(_minima(F.col(text) if isinstance(text, str) else text, unit, k, w))


def with_fingerprint(df: DataFrame, text: str, out: str, unit: int = UNIT, k: int = K, w: int = WINDOW) -> DataFrame:
    return df.withColumn(out, fingerprint(text, unit, k, w))


def hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda c: F.shiftright(c, 32)))


def written(fingerprint: str) -> Column:
    """``hash:position`` of all chosen grams, hashes in hexadecimal, comma-joined."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda c: F.concat(
        F.hex(F.shiftright(c, 32)), F.lit(":"), F.bitwise_not(c).bitwiseAND(F.lit(LOW)).cast("string"))), ","))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _splitters(df: DataFrame, key: str, n: int) -> list[int]:
    """About ``n`` keys, ascending, that part the rows evenly; the first is the smallest key."""
    found = df.agg(F.min(key), F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10 * n)).first()
    return sorted({x for x in (found[0], *(found[1] or [])) if x is not None})


def with_next(df: DataFrame, key: str, text: str, run) -> DataFrame:
    """``run(df, next_of)`` over rows in key order, where ``next_of(c)`` is column ``c`` of the next row.

    ``next_of(c, step)`` looks ``step`` rows on, or back, and is NULL where there is none. Rows are cut into
    key ranges. The first row of each range also visits the range before (the very first the last one), so that
    one shuffle of the texts serves all rows. Rows without key come first in the first range; rows of one key
    follow each other by text. ``run`` keeps the two columns that are added, the last ones.
    """
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = _splitters(df, key, n)
    if not starts:
        starts = [0]
    range_, guest = free_name(df, "_range"), free_name(df, "_guest")
    step = 64
    coarse = F.array(*[F.lit(s).cast("bigint") for s in starts[::step]])
    fine = F.array(*[F.lit(s).cast("bigint") for s in starts])
    block = F.greatest(F.size(F.filter(coarse, lambda s: s <= F.col(key))) - 1, F.lit(0))
    within = F.size(F.filter(F.slice(fine, block * step + 1, F.lit(step)), lambda s: s <= F.col(key)))
    own = F.greatest(block * step + within - 1, F.lit(0))
    visits = F.filter(F.array(F.struct(own.alias(range_), F.lit(0).alias(guest)),
                              F.when(F.get(fine, own) == F.col(key), F.struct(
                                  F.pmod(own - 1, F.lit(len(starts))).alias(range_), F.lit(1).alias(guest)))),
                      lambda v: v.isNotNull())
    placed = df.select("*", F.inline(visits))
    order = Window.partitionBy(range_).orderBy(guest, F.col(key).asc_nulls_first(), text)

    def next_of(c: str, step: int | None = None) -> Column:
        if step is not None:
            return F.lead(c, step).over(order) if step > 0 else F.lag(c, -step).over(order)
        # the last row of a range without a following one (no row has a key) has itself for its next
        return F.coalesce(F.lead(c).over(order), F.col(c))

    return run(placed, next_of).where(F.col(guest) == 0).drop(range_, guest)


def with_edited(df: DataFrame, key: str, text: str, k: int = K, w: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of the text whose second half is the beginning of the next one.

    Every character is hashed once. The edited text is a beginning of the own text, then one of the next: its
    windows are those of the own text that end before the seam, those of the next text, moved, and the few
    across the seam, which come from the ``k + w - 2`` characters on each side of it. A row picks what the row
    before needs of it, by that row's length, so only chosen grams go from row to row.

    Adds ``n_chars``, ``edited`` (the text), ``own`` and ``changed`` (arrays as :func:`fingerprint` has them),
    ``following`` (the hashes of the next row's fingerprint). Names that ``df`` has are not allowed.
    """
    size = k + w - 2

    def before(c: str, last: Column) -> Column:
        """The grams chosen by the windows up to the one that chose ``last``; none if it is NULL."""
        return F.slice(c, F.lit(1), F.coalesce(F.array_position(c, last), F.lit(0)).cast("int"))

    def run(df, next_of):
        place = df.columns[-2:]
        kept = [c for c in df.columns if c not in (text, *place)]
        df = df.withColumn("n_chars", F.length(text).cast("bigint"))
        df = df.withColumns({"_next": next_of(text), "_has": next_of("n_chars", 1).isNotNull(), "_before": next_of("n_chars", -1)})
        half = F.floor(F.col("n_chars") / F.lit(2)).cast("int")
        mine = F.substring(text, F.lit(1), (F.col("n_chars") - half).cast("int"))
        theirs = F.substring("_next", F.lit(1), half)
        asked = F.substring(text, F.lit(1), F.floor(F.col("_before") / F.lit(2)).cast("int"))
        df = df.withColumns({"edited": F.concat(mine, theirs), "_mine": _bare(mine), "_theirs": _bare(theirs), "_b": F.length(_bare(asked))})
        df = df.withColumns({"_a": F.length("_mine"), "_seam": F.concat(F.right("_mine", F.lit(size)), F.left("_theirs", F.lit(size)))})
        # the windows inside the first x characters are the first x - (k + w - 2)
        found = _let(_minima(F.col(text), 1, k, w), lambda m: F.struct(
            F.array_distinct(m).alias("own"), F.get(m, F.col("_a") - size - 1).alias("cut"), F.get(m, F.col("_b") - size - 1).alias("asked")))
        df = df.withColumn("_found", found).withColumn("own", F.col("_found.own"))
        df = df.select(*kept, *place, text, "n_chars", "edited", "own", "_a", "_has", before("own", F.col("_found.cut")).alias("_head"),
                       before("own", F.col("_found.asked")).alias("_given"),
                       # without a next row the text goes on with itself
                       F.when(F.col("_has"), fingerprint("_seam", 1, k, w)).otherwise(fingerprint("edited", 1, k, w)).alias("_seam"), hashes("own").alias("_hashes"))
        df = df.withColumns({"_given": next_of("_given", 1), "following": next_of("_hashes")})
        moved = F.transform("_seam", lambda g: g - F.greatest(F.col("_a") - size, F.lit(0)))
        rest = F.transform("_given", lambda g: g - F.col("_a"))
        whole = F.array_distinct(F.concat("_head", moved, rest))
        return df.select(*kept, "n_chars", "edited", "own", F.when(F.col("_has"), whole).otherwise(F.col("_seam")).alias("changed"), "following", *place)

    return with_next(df, key, text, run)


def op4_winnow(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_edited(docs, "doc_id", "text")
    found = found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         written("own").alias("fingerprint"), written("changed").alias("edited_fingerprint"),
                         hashes("own").alias("own"), hashes("changed").alias("changed"), "following")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))
