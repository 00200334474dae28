"""Chat formatting with collapse of cumulative snapshots.

Chat logs often hold a conversation several times, each time a turn longer. Each turn gets a rolling prefix
hash: the XOR of two 64-bit hashes of (position, role, text) over the turns so far, 128 bits that depend on
the turns in their order. A conversation whose whole hash is the prefix hash of a longer one is a snapshot
of that one; of equal conversations the one with the smallest conv_id stays. Both are found on distinct hashes, so a
first turn that very many conversations share is one row in the joins. What stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save


def turn_text(role: Column, text: Column) -> Column:
    """One rendered turn; markers inside a role or text are broken, so that no text can pose as a turn."""
    plain = lambda c: F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit("<|"), plain(role), F.lit("|>\n"), plain(text), F.lit("<|end|>\n"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that stay. turns: conv_id, turn, role, text."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "d1", "d2")
    digests = rows.select("conv_id", "turn", "role", F.xxhash64(F.lit("a"), "role", "text").alias("d1"), F.xxhash64(F.lit("b"), "text", "role").alias("d2"))
    placed = digests.withColumn("n", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = placed.select(
        "conv_id", "n",
        F.bit_xor(F.xxhash64("n", "d1", "d2")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("d2", "n", "d1")).over(so_far).alias("h2"),
        F.lead("n").over(order).isNull().alias("whole"),
    )
    hashed = save(hashed)
    key = ["h1", "h2", "n"]
    whole = hashed.where("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = hashed.where("NOT whole").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of maximal conversations.

    Turns are ordered by turn, then role, then text's hash; a turn that repeats counts as often as it
    occurs. Null roles and texts are empty, a null turn comes first, rows without conv_id belong to no
    conversation, an empty table gives no row. A conversation is one row of the result, whole.
    """
    stay = save(maximal(turns))
    own = turns.join(stay.select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    entry = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), "role", F.xxhash64(F.lit("a"), "role", "text").alias("d1"), F.xxhash64(F.lit("b"), "text", "role").alias("d2"), turn_text(F.col("role"), F.col("text")).alias("shown"))
    shown = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    return shown.join(stay, "conv_id").select("conv_id", "n_turns", F.array_join(F.col("t.shown"), "").alias("rendered"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  p AS (SELECT conv_id, turn, role, text, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
    string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
  whole AS (SELECT prefix, min(conv_id) AS conv_id, any_value(total) AS n_turns FROM p WHERE n = total GROUP BY prefix),
  stay AS (SELECT conv_id, n_turns FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < total))
SELECT t.conv_id, any_value(n_turns) AS n_turns,
  string_agg('<|' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) || replace(replace(text, '<|', '< |'), '|>', '| >') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM t JOIN stay USING (conv_id) GROUP BY t.conv_id
"""
