"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

*Targets.* All words are shared out over the sources by weight. A source whose share is above ``max_epochs``
times its own size is clamped there, and what it can't take is shared by weight among the others, again and
again until none is above. Each round is one aggregate over the table of sources; the driver sees three sums.

*Sample.* A source takes its target, rounded, as whole repetitions of all its documents and a fractional one:
its documents stand in the order of a seeded hash of their key, and the first of them are taken once more until
the rest is used up; of the one in which it ends only the missing words are taken. So each source takes its
rounded target exactly, no document exceeds ``max_epochs`` times its size, and the same seed gives the same mix.

Running sums over a source go in two levels, over buckets of the hash and inside a bucket, about the square root
of the number of rows each. A source with a third of all rows is therefore spread over all tasks, and no window
holds a source. Sources are numbered in code point order by key ranges and the counts of those.

Words are the runs of characters other than blanks (space, tab, line ends). A null text has none. Rows without a
source are a source of their own, the last one. A source without words, or a table without words, has target 0.
Repeated rows are rows like others; which of two equal ones is taken can't be told. An empty table gives no rows.
Other columns are kept by :func:`mix`; its own get underscores where a name is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.llm.common import free_name, table
from wellspan.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS = 32


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with a number from 0 in ``order``; no task sees more than a range of the rows.

    Ranges are written down, so that a row can't change its range when a task is run again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each of at most ``n`` ranges
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + at).drop("_range", "_before")


def water_fill(sources: DataFrame, size: str, weight: str, max_epochs: int, out: str) -> DataFrame:
    """``sources`` (one row each) with the target ``out`` of each; the targets add up to the sum of sizes.

    The level of a round is what is left for the sources that aren't clamped over their weights. It never falls,
    so neither does the number of clamped sources; when that stays, no share is above its limit.
    """
    cap = F.col(size) * F.lit(max_epochs)
    share = F.col(weight).cast("double")
    total, weights = (x or 0 for x in sources.agg(F.sum(size), F.sum(weight)).first())
    left, open_weights, clamped = total, weights, 0

    def above() -> Column:
        return cap.cast("double") * F.lit(float(open_weights)) <= F.lit(float(left)) * share

    while open_weights:
        now, taken, gone = (x or 0 for x in sources.where(above()).agg(F.count(F.lit(1)), F.sum(cap), F.sum(weight)).first())
        if now == clamped:
            break
        clamped, left, open_weights = now, total - taken, weights - gone
    if not open_weights:  # all are full
        return sources.withColumn(out, cap.cast("double"))
    return sources.withColumn(out, F.when(above(), cap.cast("double")).otherwise(
        F.lit(float(left)) * share / F.lit(float(open_weights))))


def _place(key: str, seed: int) -> Column:
    """Seeded order of documents: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def taken(docs: DataFrame, key: str, source: str, size: str, weights: list[int], max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """For each row of ``docs`` (written down, with the size) what the mix takes of it.

    Adds ``source_size``, ``target``, ``copies`` (whole repetitions), ``part`` (words of one more) and
    ``taken``. ``weights`` are dealt to the sources in turn, in code point order.
    """
    mine = {c: free_name(docs, c) for c in ("_none", "_name", "_place", "_bucket")}
    none, name, place, bucket = (mine[c] for c in ("_none", "_name", "_place", "_bucket"))
    rows = docs.count()
    bits = min(HASH_BITS, max(0, math.ceil(math.log2(max(rows, 1)) / 2)))
    first = F.conv(F.substring(place, 1, 8), 16, 10).cast("bigint")
    docs = docs.withColumns({none: F.col(source).isNull(), name: F.coalesce(F.col(source), F.lit("")), place: _place(key, seed)})
    docs = docs.withColumn(bucket, F.shiftright(first, HASH_BITS - bits).cast("int"))
    by = [none, name]
    buckets = materialize(docs.groupBy(*by, bucket).agg(F.sum(size).alias("_size")), "mix-buckets")
    sources = numbered(buckets.groupBy(*by).agg(F.sum("_size").alias("source_size")), by, "_at")
    turn = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_at") % F.lit(len(weights))).cast("int"))
    sources = materialize(sources.withColumn("_weight", turn).drop("_at"), "mix-sources")
    filled = water_fill(sources, "source_size", "_weight", max_epochs, "target").drop("_weight")
    goal = F.round("target").cast("bigint")
    copies = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("bigint"))
    filled = filled.withColumn("copies", copies).withColumn("_rest", goal - F.col("copies") * F.col("source_size"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = buckets.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size").join(filled, by)
    inside = Window.partitionBy(*by, bucket).orderBy(place, key, size).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    part = F.greatest(F.least(F.col("_rest") - start, F.col(size)), F.lit(0).cast("bigint"))
    out = docs.join(sums, [*by, bucket]).withColumn("part", part)
    out = out.withColumn("taken", F.col("copies") * F.col(size) + F.col("part"))
    return out.drop(*mine.values(), "_before", "_rest")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: list[int] | None = None,
        max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mixed corpus: each taken document as often as it is taken, the last time perhaps cut after a word.

    Returns the columns of ``docs`` and ``copy`` (from 0).
    """
    copy = free_name(docs, "copy")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(text).alias("_words"))
    found = taken(materialize(packed, "mix-docs"), "_key", "_source", "_words", weights or [1, 2, 3], max_epochs, seed)
    rows = found.where("taken > 0").withColumn("_copy", F.explode(F.expr("sequence(1, copies + if(part > 0, 1, 0))")))
    spans = F.regexp_extract_all(F.col(f"_row.{text}"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    partly = F.array_join(F.slice(spans, F.lit(1), F.col("part").cast("int")), "")
    new = F.when((F.col("_copy") > F.col("copies")) & (F.col("part") < F.col("_words")), partly).otherwise(F.col(f"_row.{text}"))
    return rows.withColumn("_text", new).select(
        *[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns], (F.col("_copy") - 1).alias(copy))


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"))
    found = taken(materialize(docs, "mix-sizes"), "doc_id", "source", "size", [1, 2, 3])
    return found.select("doc_id", "size", "source_size", "target", "taken")


# the level from sorted limits: the clamped sources are those with the smallest limit over weight
OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, 1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, COALESCE(SUM(3 * source_size) OVER f, 0) AS caps, COALESCE(SUM(w) OVER f, 0) AS ws, SUM(source_size) OVER () AS total, SUM(w) OVER () AS all_w
  FROM s WINDOW f AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
-- the first source, by limit over weight, that the level of it and all later ones doesn't fill
l AS (SELECT total - caps AS left_, all_w - ws AS open_ FROM o WHERE CAST(3 * source_size AS HUGEINT) * (all_w - ws) > (total - caps) * w
  ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT s.source, s.source_size, CASE WHEN l.open_ IS NULL OR CAST(3 * source_size AS HUGEINT) * l.open_ <= l.left_ * s.w THEN CAST(3 * source_size AS DOUBLE)
  ELSE CAST(l.left_ AS DOUBLE) * w / CAST(l.open_ AS DOUBLE) END AS target FROM s LEFT JOIN l ON true),
r AS (SELECT *, CAST(round(target) AS BIGINT) AS goal FROM t),
b AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.goal,
  CAST(COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY md5('7:' || COALESCE(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_
  FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  CAST((goal // source_size) * size + greatest(least(goal - (goal // source_size) * source_size - before_, size), 0) AS BIGINT) END AS taken FROM b"""
