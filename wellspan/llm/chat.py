"""Chat formatting by perspective rotation.

Every participant of a conversation gets a view of it: that speaker's turns are the assistant's, all other
speakers' are a named user's, and the mask covers what the assistant says. System turns stay system turns
in every view; a speaker named ``system`` is no participant. A view has one row per turn with its place in
the rendering, so that no conversation, however long, has to fit in a task: running lengths are summed in
blocks of ``BLOCK`` turn numbers, then over the blocks.

A null role is the speaker ``unknown``, a null text empty, a null conversation one of its own; a null
turn comes first. Turns of one number follow each other by role, then text; repeated rows stay. A
conversation of system turns only has no view. Empty tables give no rows; other columns of the turns,
whatever their names, are left out.

A turn can't forge another: turn markers inside a text lose their bars (``<im_end>``). User names have no
blanks; those, and ``%`` itself, are written as ``%`` and their code, so that different speakers stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wellspan.llm.common import table

BLOCK = 1024
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
# fixed values: how a blank and the sign of the code are written in a name
CODED = [("%", "%25"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\x0b", "%0B"), ("\f", "%0C"), ("\r", "%0D")]


def harmless(text: Column) -> Column:
    """``text`` with the bars of turn markers taken out."""
    for marker in (START, END):
        text = F.replace(text, F.lit(marker), F.lit(marker.replace("|", "")))
    return text


def name(role: Column) -> Column:
    for blank, code in CODED:
        role = F.replace(role, F.lit(blank), F.lit(code))
    return harmless(role)


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, perspective, position, turn, speaker, segment, trained, char_start, char_end, mask_start, mask_end)."""
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("unknown")).alias("r"),
                        harmless(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    people = rows.where(F.col("r") != SYSTEM).select(F.col("c").alias("pc"), F.col("r").alias("p")).distinct()
    trained = F.col("r") == F.col("p")
    head = F.concat(F.lit(START), F.when(trained, F.lit("assistant")).when(F.col("r") == SYSTEM, F.lit(SYSTEM)).otherwise(
        F.concat(F.lit("user name="), name(F.col("r")))), F.lit("\n"))
    tail = F.lit(END + "\n")
    views = rows.join(people, F.col("c").eqNullSafe(F.col("pc"))).select(
        "c", "p", "t", "r", "x", trained.alias("trained"), head.alias("head"), F.concat(head, "x", tail).alias("segment"),
        F.floor(F.coalesce("t", F.lit(-1)) / F.lit(BLOCK)).alias("b"))
    views = views.withColumn("n", F.length("segment").cast("bigint"))
    order = [F.col("t").asc_nulls_first(), F.col("r"), F.col("x")]
    inside = Window.partitionBy("c", "p", "b").orderBy(*order)
    views = views.select("*", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                         F.row_number().over(inside).alias("place"))
    before = Window.partitionBy("c", "p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = views.groupBy("c", "p", "b").agg(F.sum("n").alias("n"), F.count("*").alias("k")).select(
        F.col("c").alias("bc"), F.col("p").alias("bp"), F.col("b").alias("bb"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    placed = views.join(blocks, F.col("c").eqNullSafe(F.col("bc")) & (F.col("p") == F.col("bp")) & (F.col("b") == F.col("bb")))
    end = F.col("n0") + F.col("upto")
    start = end - F.col("n")
    said = start + F.length("head")

    def masked(c: Column) -> Column:
        return F.when(F.col("trained"), c)

    return placed.select(
        F.col("c").alias(conv), F.col("p").alias("perspective"), (F.col("k0") + F.col("place") - 1).alias("position"), F.col("t").alias(turn),
        F.col("r").alias("speaker"), "segment", "trained", start.alias("char_start"), end.alias("char_end"),
        masked(said).alias("mask_start"), masked(said + F.length("x") + F.lit(len(END))).alias("mask_end"))


def op8_perspectives(spark, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS r,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS x FROM conversations),
people AS (SELECT DISTINCT conv_id AS pc, r AS p FROM turns WHERE r <> 'system'),
views AS (
  SELECT conv_id, p, turn, r, x, r = p AS trained,
         '<|im_start|>' || CASE WHEN r = p THEN 'assistant' WHEN r = 'system' THEN 'system'
                                ELSE 'user name=' || replace(replace(replace(replace(replace(replace(replace(replace(replace(
                                  r, '%', '%25'), ' ', '%20'), chr(9), '%09'), chr(10), '%0A'), chr(11), '%0B'), chr(12), '%0C'), chr(13), '%0D'),
                                  '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') END || chr(10) AS head
  FROM turns JOIN people ON conv_id IS NOT DISTINCT FROM pc),
rendered AS (SELECT *, head || x || '<|im_end|>' || chr(10) AS segment FROM views),
placed AS (
  SELECT *, CAST(SUM(length(segment)) OVER w AS BIGINT) AS char_end, CAST(ROW_NUMBER() OVER w AS BIGINT) - 1 AS position
  FROM rendered WINDOW w AS (PARTITION BY conv_id, p ORDER BY turn NULLS FIRST, r, x ROWS UNBOUNDED PRECEDING))
SELECT conv_id, p AS perspective, position, turn, r AS speaker, segment, trained,
       char_end - length(segment) AS char_start, char_end,
       CASE WHEN trained THEN char_end - length(segment) + length(head) END AS mask_start,
       CASE WHEN trained THEN char_end - length(segment) + length(head) + length(x) + 10 END AS mask_end
FROM placed"""
