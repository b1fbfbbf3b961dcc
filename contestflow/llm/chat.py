"""Chat formatting after a cumulative-snapshot collapse.

Logs often store a conversation again after every turn, so most records are prefixes of a
longer one. Rolling hashes identify every turn prefix; anti-joins keep the maximal
conversations, which are then rendered with a chat template. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

SUMS = ("s0", "s1", "s2", "s3")


def rolling(turns: DataFrame) -> DataFrame:
    """One row per turn with its position ``k`` and the rolling hash of the turns up to it.

    The hash of a prefix is the running sum of position-salted hashes of (role, text), four
    sums of 32 bits each: it needs one running window, whose memory does not grow with the
    length of the conversation, and equal prefixes have equal sums.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    t = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("k", F.row_number().over(w).cast("long")).withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    low = F.lit(0xFFFFFFFF)
    parts = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), "k", "role", "text")
        parts += [h.bitwiseAND(low), F.shiftrightunsigned(h, 32)]
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return t.select("*", *[F.sum(p).over(upto).alias(s) for p, s in zip(parts, SUMS, strict=True)])


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, n_copies, text.

    A conversation that equals the first turns of a longer one goes; of equal conversations the
    smallest conv_id stays and ``n_copies`` counts them. Turns are ordered by (turn, role,
    text), null turn numbers first; repeated rows are repeated turns. A null role is rendered
    as ``unknown``, a null text as an empty one. Rows without conv_id belong to no conversation
    and are left out. Other columns are ignored. No rows give no rows. The rendered text is one
    value of a row, so a conversation, however long, has to fit in one; its turns are numbered and
    summed up in one sorted window, which spills.

    Copies are pre-aggregated to one row per hash on both sides of the anti-join, so a hot first
    turn or conversation costs one row per task.
    """
    rolled = rolling(turns)
    key = ["k", *SUMS]
    longer = rolled.filter(~F.col("last")).select(*key).distinct()
    whole = rolled.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    maximal = whole.join(longer, key, "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")
    kept = rolled.join(maximal.select("conv_id"), "conv_id", "left_semi")  # only what stays is rendered
    texts = kept.select("conv_id", "k", render(F.col("role"), F.col("text")).alias("part")).groupBy("conv_id")
    joined = texts.agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
    return maximal.join(joined, "conv_id").select(
        "conv_id", "n_turns", "n_copies", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text")
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY k) AS turns,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS text
  FROM o GROUP BY conv_id),
g AS (
  SELECT min(conv_id) AS conv_id, any_value(n) AS n, count(*) AS n_copies, turns, any_value(text) AS text FROM c GROUP BY turns)
SELECT conv_id, n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, text FROM g
WHERE NOT EXISTS (SELECT 1 FROM g AS x WHERE x.turns[1] = g.turns[1] AND x.n > g.n AND x.turns[1:g.n] = g.turns)"""
