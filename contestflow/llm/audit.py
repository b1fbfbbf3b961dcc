"""Filter interaction audit: what each filter removes in every order of applying them.

Every document gets one bit per filter that it fails. Counts per part and mask (a handful of rows)
go through the subset-zeta transform, which gives the survivors of every subset of filters; a step
of an order is then the difference of two neighbouring subsets, for all documents and for the
labelled ones alike, and the Shapley value a weighted sum of such differences.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, words_of

#: Rows without a key are dealt to so many keys of their own when labels are joined.
SALTS = 1024
#: What is counted per part and mask.
KINDS = ("rows", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The contract's filters A to D as conditions on a text that is not null; true is failed."""
    words = words_of(text)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def fail_masks(docs: DataFrame, conditions: Mapping[str, Column], duplicates: str | None, text: str = "text", part: str = "source", key: str = "doc_id") -> DataFrame:
    """doc_id, part, hash, mask, n: documents by the filters that they fail, equal rows counted.

    Bit k of the mask stands for the k-th name in order, of ``conditions`` and ``duplicates``
    together. The bit of ``duplicates`` is set where a row of smaller key has the same text (by
    SHA-256). Conditions are given on the column ``_text``. Rows are narrow from the scan on; a
    text is compared through the pairs (least key, hash), so that no group of copies meets in a
    task: rows are joined to those pairs by key and hash, which no two different rows share.
    """
    names = sorted([*conditions, *([duplicates] if duplicates else [])])
    whole = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    bits = [F.when(c, 1 << names.index(k)).otherwise(0) for k, c in conditions.items()]
    own = whole.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("hash"), reduce(Column.__add__, bits, F.lit(0)).alias("mask"))
    rows = materialize(own.groupBy("doc_id", "part", "hash", "mask").agg(F.count("*").alias("n")), "masks")
    if not duplicates:
        return rows
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(again, 1 << names.index(duplicates)).otherwise(0)
    return rows.join(first, ["hash", "doc_id"], "left").select("doc_id", "part", "hash", mask.alias("mask"), "n")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, rows, good, toxic. A document is good or toxic if any label of its key says so."""
    flags = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("hash"), F.lit(SALTS))).otherwise(F.lit(0)).cast("long")
    joined = masks.withColumn("salt", salt).join(flags.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    marked = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in KINDS[1:]]
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("rows"), *marked)


def survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """One row per part with an array for each kind: element S is what survives the subset S.

    The subset-zeta transform, a pass per filter, sums the counts of all masks inside each set;
    what survives S are the masks inside its complement.
    """
    full = (1 << n_filters) - 1
    byte = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*KINDS).alias("v"))))
    by_part = counts.groupBy("part").agg(byte.alias("by_mask"))

    def start(kind: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.col("by_mask")[m][kind], F.lit(0).cast("long")))

    sums = by_part.select("part", *[start(k).alias(k) for k in KINDS])
    for b in range(n_filters):
        bit = 1 << b

        def add(a: Column, bit: int = bit) -> Column:
            return F.transform(a, lambda v, i: v + F.when(i.bitwiseAND(bit) != 0, F.get(a, i - bit)).otherwise(F.lit(0)))

        sums = sums.select("part", *[add(F.col(k)).alias(k) for k in KINDS])
    return sums.select("part", *[F.reverse(k).alias(k) for k in KINDS])  # the complement of S is full - S


def shapley(rows: Column, b: int, n_filters: int) -> Column:
    """What filter ``b`` removes, summed over all orders: subsets weighted by the orders that have
    exactly that subset before the filter."""
    bit, parts = 1 << b, []
    for s in range(1 << n_filters):
        if not s & bit:
            orders = factorial(s.bit_count()) * factorial(n_filters - 1 - s.bit_count())
            parts.append(orders * (F.get(rows, F.lit(s)) - F.get(rows, F.lit(s | bit))))
    return reduce(Column.__add__, parts)


def order_steps(surviving: DataFrame, names: str) -> DataFrame:
    """One row per part, order and step; every number is read off the survivors."""
    k, full = len(names), (1 << len(names)) - 1
    orders = F.array(*[F.lit("".join(o)) for o in permutations(names)])
    rows = surviving.withColumn("shapleys", F.array(*[shapley(F.col("rows"), b, k) for b in range(k)]))
    rows = rows.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bits = {x: 1 << b for b, x in enumerate(names)}
    earlier = reduce(Column.__add__, [F.when(F.locate(x, F.col("filter_order")) < F.col("step"), v).otherwise(0) for x, v in bits.items()])
    at = F.array_position(F.array(*[F.lit(x) for x in names]), F.substring("filter_order", F.col("step"), F.lit(1))).cast("int") - 1
    rows = rows.withColumns({"before": earlier, "at": at}).withColumn("bit", F.get(F.array(*[F.lit(1 << b) for b in range(k)]), F.col("at")))

    def left(kind: str, subset: Column) -> Column:
        return F.get(F.col(kind), subset)

    def lost(kind: str) -> Column:
        return left(kind, F.col("before")) - left(kind, F.col("before") + F.col("bit"))

    failing = left("rows", F.lit(0)) - left("rows", F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", left("rows", F.col("before") + F.col("bit")).alias("kept"), lost("rows").alias("removed"), (failing - lost("rows")).alias("redundant"),
        (left("rows", F.lit(full) - F.col("bit")) - left("rows", F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shapleys", F.col("at")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column] | None = None, duplicates: str | None = "E") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``conditions``: names of one letter to conditions on ``_text``; by default the contract's A to D.
    ``duplicates`` names the filter of texts that a smaller doc_id has too. k filters give k! orders
    of k steps for each part, so k should stay below eight.

    A null text is an empty one, a null source the part of the empty string. Rows without doc_id
    never fail as duplicates and have no labels; repeated rows count each, and since none has a
    smaller doc_id, they are no duplicates of each other. Of several labels of a doc_id one that says
    1 suffices; null labels say nothing. A long text is judged whole, in its row. Other columns are
    ignored. No documents give no rows: there is no part.
    """
    conditions = failures(F.col("_text")) if conditions is None else conditions
    names = "".join(sorted([*conditions, *([duplicates] if duplicates else [])]))
    masks = fail_masks(docs, conditions, duplicates)
    return order_steps(survivors(mask_counts(masks, labels), len(names)), names)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
g AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM w LEFT JOIN g USING (doc_id)),
c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || letter FROM o, letters WHERE NOT contains(filter_order, letter) AND length(filter_order) < 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier
  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
b AS (
  SELECT filter_order, step::INT AS step, letter, 1 << (ascii(letter) - 65) AS bit,
         list_sum(list_transform(['A', 'B', 'C', 'D', 'E'], lambda x: CASE WHEN contains(earlier, x) THEN 1 << (ascii(x) - 65) ELSE 0 END))::INT AS before
  FROM s),
r AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, b GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM r"""
