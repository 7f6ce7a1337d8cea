"""Cumulative-snapshot collapse of logged conversations, then chat rendering. DataFrame functions only.

A logger that writes a conversation after every turn leaves snapshots, each a prefix of the next. Every turn gets a rolling
hash of the turns up to it: the running sum of hashes of (position, role, text), four sums of 31 bits each. A conversation
whose full hash occurs as a shorter prefix of another one goes; of equal conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ("s1", "s2", "s3", "s4")
BLOCK = 4096  # turn numbers per block of a conversation


def _terms() -> dict[str, Column]:
    """Four 31-bit hashes of a turn at its position; missing values differ from empty ones."""
    content = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    out = {}
    for k, salt in ((0, 17), (2, 71)):
        h = F.xxhash64(F.lit(salt), *content)
        out[SUMS[k]] = F.shiftrightunsigned(h, 33)
        out[SUMS[k + 1]] = h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    return out


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, pos from 1, n, s1..s4): sums over the turns up to and with pos.

    Turns are ordered by turn, role, text (missing values first); repeated turns all count. A conversation is handled in
    blocks of turn numbers joined by their totals, so that one with a third of all turns is no single group.
    """
    rows = turns.select("conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).alias("block"), "turn", "role", "text")
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("k"))
    bases = counts.select(
        F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"), F.sum("k").over(whole).alias("n")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    placed = rows.withColumn("i", F.row_number().over(in_block)).join(bases, same).drop("_c", "_b")
    placed = placed.withColumn("pos", F.col("base") + F.col("i")).withColumns(_terms())
    sums = placed.groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in SUMS])
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"before_{s}") for s in SUMS])
    running = placed.withColumns({s: F.sum(s).over(upto) for s in SUMS}).join(sums, same)
    return running.select("conv_id", "role", "text", "pos", "n", *[(F.col(s) + F.col(f"before_{s}")).alias(s) for s in SUMS])


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id of each conversation that is neither a prefix of a longer one nor a later copy of an equal one."""
    full = hashed.filter("pos = n").groupBy("n", *SUMS).agg(F.min("conv_id").alias("conv_id"))
    prefixes = hashed.filter("pos < n").select(F.col("pos").alias("n"), *SUMS).distinct()
    return full.join(prefixes, ["n", *SUMS], "left_anti").select("conv_id")


def collapse_and_render(turns: DataFrame, turns_per_part: int = 1024) -> DataFrame:
    """One row per kept conversation and part: conv_id, part, n_turns (of the conversation), text.

    Turns render as `<|role|>`, a line break, the text, `<|end|>` and a line break; a missing role is `unknown`, a missing text
    is empty, and `<|` inside either becomes `< |`. A conversation beyond `turns_per_part` turns goes on in further parts, so
    no row grows without bound. Rows without conv_id form one conversation; extra columns are ignored.
    """
    hashed = rolling_hashes(turns)
    keep = maximal(hashed).select(F.col("conv_id").alias("_c"))
    kept = hashed.join(keep, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    clean = lambda c, default: F.replace(F.coalesce(F.col(c), F.lit(default)), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|"), clean("role", "unknown"), F.lit("|>\n"), clean("text", ""), F.lit("<|end|>\n"))
    part = F.floor((F.col("pos") - 1) / turns_per_part)
    lines = kept.select("conv_id", part.alias("part"), "n", F.struct("pos", line.alias("line")).alias("turn"))
    grouped = lines.groupBy("conv_id", "part", F.col("n").alias("n_turns")).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", "part", "n_turns", F.array_join("turns.line", "").alias("text"))


SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT *, string_agg(CASE WHEN role IS NULL THEN '-' ELSE strlen(role) || ':' || role END || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END, '')
            OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM t),
u AS (SELECT min(conv_id) AS conv_id, n, prefix FROM p WHERE pos = n GROUP BY n, prefix),
kept AS (SELECT conv_id FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = u.n AND p.prefix = u.prefix))
SELECT conv_id, CAST((pos - 1) // 1024 AS BIGINT) AS part, n AS n_turns,
       string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM t WHERE EXISTS (SELECT 1 FROM kept WHERE kept.conv_id IS NOT DISTINCT FROM t.conv_id)
GROUP BY conv_id, (pos - 1) // 1024, n
"""
