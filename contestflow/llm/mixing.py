"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash. A document's virtual finish time is the running
total of its source's words divided by the source's target; sorting all sources by it serves
each in proportion, and the mix ends where the running total of all reaches the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, materialize, table
from .prefix import running_total


def targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """(source, rank, source_size, target) from (source, size), one row per source.

    Sources in order of code points, null last, take the weights in turn. A target stops at
    ``epochs`` times its source's size and the excess goes to the others by weight: with sources
    sorted by limit per weight, those below the common level are the ones that stop. These windows
    see one row of some hundred bytes per source in one task, which spills: made for up to some
    millions of sources; documents never meet there.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(order).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(epochs)))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("place", F.row_number().over(by_level))
    open_ = F.col("limit") / F.col("weight") > F.col("level")
    s = s.withColumn("common", F.min(F.when(open_, F.struct("place", "level"))).over(everything))
    stops = F.col("common").isNull() | (F.col("place") < F.col("common.place"))
    return s.select("source", "rank", "source_size", F.when(stops, F.col("limit")).otherwise(F.col("weight") * F.col("common.level")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 7, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document (and ``row``, a unique key).

    size: words of the text (null: 0); taken: words that the mix takes of it, repeats counted.
    The document at the end of the budget is taken in part. Runs on the same rows agree: order
    depends on doc_id and text alone. Repeated rows are documents of their own; a null source
    is a source; documents without words take nothing. A long text is counted whole, and its size is
    all that moves. Equal hashes are told apart by doc_id and then by the row. Other columns are
    ignored, whatever their names. No rows give no rows.
    """
    key = F.col(row) if row else F.monotonically_increasing_id()
    narrow = docs.select(key.alias("row"), "doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"))
    sizes = materialize(narrow, "sizes")
    goal = materialize(targets(sizes, weights, share, epochs), "targets")
    budget = goal.agg(F.floor(F.sum("source_size") * F.lit(float(share))).alias("budget"))
    known = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).drop("source")
    queued = running_total(known, ["rank", "hash", "doc_id", "row"], "size", "served", "rank")
    turns = queued.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    finish = (F.col("served") + F.col("epoch") * F.col("source_size")) / F.col("target")
    turns = turns.withColumn("finish", F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0))).drop("served")
    ordered = running_total(turns, ["finish", "rank", "epoch", "hash", "row"], "size", "mixed")
    cut = ordered.crossJoin(F.broadcast(budget))  # one row
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("mixed") + F.col("size")))
    first = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    out = cut.withColumn("part", part).groupBy("row").agg(*first, F.sum("part").cast("long").alias("taken"))
    return out.select(*([F.col("row").alias(row)] if row else []), "doc_id", "size", "source_size", "target", "taken")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
