"""Entity-time operators that never see the current row, and global orders without one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written


def ranged(df: DataFrame, entity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned by entity and order, with the number ``_part`` of the part; written
    once, which fixes the parts. A long entity spans several parts that follow each other."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *entity, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def with_halo(parts: DataFrame, entity: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The rows of every part (``_part``) and, marked by ``_halo``, the last ``n`` rows of each of its
    entities in the parts before, so that windows of ``n`` rows stay inside a part.

    Of each part at most ``n`` rows an entity travel; an entity has a row in every part it spans,
    so ``n`` parts back are enough.
    """
    columns = [c for c in parts.columns if c not in (*entity, "_part")]
    back = Window.partitionBy(*entity, "_part").orderBy(*[F.col(c).desc() for c in order])
    row = F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.struct(*columns).alias("_row"))
    last = parts.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n)
    tails = last.select(*entity, "_part", F.col("_back"), row.alias("_tail")).groupBy(*entity, "_part").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_back"), "_tail"))), lambda x: x["_tail"]).alias("_tails"))
    before = Window.partitionBy(*entity).orderBy("_part").rowsBetween(-n, -1)
    halo = tails.withColumn("_all", F.flatten(F.collect_list("_tails").over(before))).select(*entity, "_part", F.explode(F.when(F.size("_all") > n, F.slice("_all", -n, n)).otherwise(F.col("_all"))).alias("_t"))
    halo = halo.select(*entity, "_part", *[F.col("_t._row")[c].alias(c) for c in columns])
    return parts.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))


def _framed(df: DataFrame, entity: Sequence[str], order: Sequence[str], n: int, split: bool) -> tuple[DataFrame, list[str]]:
    """Rows to put windows of ``n`` earlier rows on, and what to partition these by."""
    if not split:
        return df.withColumn("_halo", F.lit(False)), [*entity]
    return with_halo(ranged(df, entity, order), entity, order, n), [*entity, "_part"]


def trailing_mean(df: DataFrame, columns: Sequence[str], entity: Sequence[str], order: Sequence[str], window: int, least: int, prefix: str = "roll_", split: bool = False) -> DataFrame:
    """Mean of the last ``window`` earlier rows; null below ``least`` non-null values. One sort for all.

    ``split`` is for few, long entities: they are cut into ranges of their order, each with the last
    rows of the range before, so an entity is the work of many tasks. The order is then total.
    """
    framed, keys = _framed(df, entity, order, window, split)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-window, -1)
    means = {prefix + c: F.when(F.count(c).over(w) >= least, F.avg(c).over(w)) for c in columns}
    return framed.withColumns(means).filter(~F.col("_halo")).select(*[c for c in df.columns if c not in means], *means)


def prior_count(df: DataFrame, entity: Sequence[str], order: Sequence[str], into: str = "prior") -> DataFrame:
    return df.withColumn(into, (F.row_number().over(Window.partitionBy(*entity).orderBy(*order)) - 1).cast("long"))


def trailing_mode(df: DataFrame, value: str, entity: Sequence[str], order: Sequence[str], window: int, into: str, split: bool = False) -> DataFrame:
    """Most frequent value of the last ``window`` earlier rows.

    Of ties the value whose present stay in the window is the longest wins; a stay starts where
    the value was absent from the ``window`` rows before. Without earlier rows: the own value.
    ``split`` as in ``trailing_mean``; positions, last occurrences and stays are carried over the
    ranges by prefix sums and maxima of one row per range, entity and value.
    """
    parts = ranged(df, entity, order) if split else df
    keys = [*entity, "_part"] if split else [*entity]

    def carried(rows: DataFrame, by: Sequence[str], what, into: str) -> DataFrame:
        """``rows`` with ``into``: what the earlier parts of the same ``by`` add up to."""
        if not split:
            return rows.withColumn(into, F.lit(None).cast("int"))
        each = rows.groupBy(*by, "_part").agg(what(F).alias("_x"))
        over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        total = F.sum("_x") if into == "_base" else F.max("_x")
        totals = each.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate((*by, "_part"))], total.over(over).alias(into))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate((*by, "_part"))])
        return rows.join(totals, same, "left").drop(*[f"_k{k}" for k in range(len(by) + 1)])

    df_columns = df.columns
    by_row, by_value = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, value).orderBy("_i")
    rows = carried(parts, entity, lambda f: f.count("*"), "_base")
    rows = rows.withColumn("_i", F.row_number().over(by_row) + F.coalesce("_base", F.lit(0)))
    rows = carried(rows, [*entity, value], lambda f: f.max("_i"), "_earlier")
    last = F.coalesce(F.lag("_i").over(by_value), "_earlier")
    rows = rows.withColumn("_last", last).withColumn("_new", F.when(F.col("_last").isNull() | (F.col("_i") - F.col("_last") > window), F.col("_i")))
    rows = carried(rows, [*entity, value], lambda f: f.max("_new"), "_begun")
    rows = rows.withColumn("_stay", F.greatest(F.max("_new").over(by_value.rowsBetween(Window.unboundedPreceding, 0)), "_begun"))
    rows = rows.select(*df_columns, *(["_part"] if split else []), "_i", "_stay")
    rows = with_halo(written(rows, "stays"), entity, ["_i"], window) if split else rows.withColumn("_halo", F.lit(False))
    frame = Window.partitionBy(*keys).orderBy("_i").rowsBetween(-window, -1)
    rows = rows.withColumn("_seen", F.collect_list(F.struct(F.col(value).alias("v"), F.col("_stay").alias("s"))).over(frame))

    def rank(v: Column) -> Column:
        own = F.filter("_seen", lambda x: x["v"] == v)
        return F.struct(-F.size(own), F.array_max(F.transform(own, lambda x: x["s"])), v.alias("v"))

    ranked = F.array_sort(F.transform(F.array_distinct(F.transform("_seen", lambda x: x["v"])), rank))
    rows = rows.filter(~F.col("_halo"))
    return rows.withColumn(into, F.coalesce(F.get(ranked, 0)["v"], F.col(value))).select(*[c for c in df_columns if c != into], into)


def overlap_with_previous(df: DataFrame, members: Column, entity: Sequence[str], order: Sequence[str], into: str, split: bool = False) -> DataFrame:
    """Members shared with the entity's previous row; null on its first. ``split`` as in ``trailing_mean``."""
    framed, keys = _framed(df.withColumn("_members", F.array_distinct(members)), entity, order, 1, split)
    rows = framed.withColumn("_before", F.lag("_members").over(Window.partitionBy(*keys).orderBy(*order))).filter(~F.col("_halo"))
    shared = F.when(F.col("_before").isNotNull(), F.size(F.array_intersect("_members", "_before")).cast("long"))
    return rows.withColumn(into, shared).select(*[c for c in df.columns if c != into], into)


def ordered_index(df: DataFrame, order: Sequence[str], into: str = "seq", groups: Sequence[str] = ()) -> DataFrame:
    """Dense position (from 1) in the order of each group, or of all rows."""
    return running(df, order, {into: F.lit(1)}, "long", groups)


def running(df: DataFrame, order: Sequence[str], sums: dict[str, Column], kind: str = "double", groups: Sequence[str] = ()) -> DataFrame:
    """Running sums (the row included) in ``order``, over all rows or per group.

    Rows are range-partitioned by group and order and written once, which fixes the parts; each
    part has its own running sums, and prefix sums over the parts' totals (one row per part and
    group) are added. The bounds of the parts follow the data and their number is that of the shuffle
    partitions, so neither a long group nor a busy month meets in one task. Groups hold no nulls; values of nulls add nothing.
    """
    parts = ranged(df.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}), groups, order)
    keys = [*groups, "_part"]
    totals = parts.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(inside) for k in sums}).join(bases, keys)
    out = out.select(*df.columns, *[(F.col(f"_s_{k}") + F.col(f"_b_{k}")).cast(kind).alias(k) for k in sums])
    out.folder = parts.folder  # what it reads, for those who store it and drop this
    return out


def average_rank(df: DataFrame, score: str, groups: Sequence[str] = (), into: str = "rank") -> DataFrame:
    """Rank from 1 with ties at their mean: prefix sums over the counts of the distinct scores."""
    counts = df.groupBy(*groups, score).agg(F.count("*").alias("_n"))
    upto = running(counts, [score], {"_upto": F.col("_n")}, "long", groups)
    ranked = upto.select(*groups, score, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(into))
    return df.join(ranked, [*groups, score])


def split_by_position(df: DataFrame, order: Sequence[str], fraction: float, into: str = "is_train") -> DataFrame:
    """True for the first ``int(n * fraction)`` rows of the global order."""
    indexed = ordered_index(df, order)
    cut = indexed.agg(F.floor(F.count("*") * F.lit(fraction)).alias("_cut"))
    return indexed.crossJoin(F.broadcast(cut)).withColumn(into, F.col("seq") <= F.col("_cut")).drop("_cut")


def latest(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], into: str) -> DataFrame:
    """The value of each group's last row; a map-side combined aggregate, no sort."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(into))


def as_of(requests: DataFrame, events: DataFrame, keys: Sequence[str], at: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``requests`` with the ``values`` of the last event of their keys before them; null without one.

    ``at`` are the requests' times and the first columns of ``order``, by which the events of a key
    follow each other. An event at the very time of a request is not before it. Of events equal in
    ``order`` the greatest values win. One pass over both tables, whatever their numbers: they are
    range-partitioned together by keys and time, each part carries the last event on, and the last
    one of earlier parts is added, so a key with many rows is the work of several tasks. A request
    with a null in keys or times finds nothing; null values of an event are values.
    """
    e = events.select(*keys, *order, F.struct(*values).alias("_value")).dropna(subset=[*keys, *order[: len(at)]])
    ask = requests.select(*keys, *at, F.struct(*requests.columns).alias("_request"))
    kinds = dict(e.dtypes)
    ask = ask.withColumns({c: F.lit(None).cast(kinds[c]) for c in order[len(at) :]}).withColumn("_value", F.lit(None).cast(kinds["_value"]))
    both = e.withColumns({"_request": F.lit(None).cast(dict(ask.dtypes)["_request"]), "_is_event": F.lit(1)}).unionByName(ask.withColumn("_is_event", F.lit(0)))
    time = [*at, "_is_event", *order[len(at) :], "_value"]  # requests come before events of their time
    parts = ranged(both, keys, time)
    inside = Window.partitionBy(*keys, "_part").orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.filter("_is_event = 1").groupBy(*keys, "_part").agg(F.max_by("_value", F.struct(*time)).alias("_end"))
    marks = parts.select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).select(*keys, "_part", "_carried")
    seen = parts.withColumn("_last", F.last("_value", ignorenulls=True).over(inside)).filter("_is_event = 0")
    out = seen.join(carried, [*keys, "_part"], "left").select("_request", F.coalesce("_last", "_carried").alias("_value"))
    known = out.select(*[F.col("_request")[c].alias(c) for c in requests.columns if c not in values], *[F.col("_value")[v].alias(v) for v in values])
    return known


def recent_form(df: DataFrame, entity: Sequence[str], order: Sequence[str], n: int, columns: Sequence[str]) -> DataFrame:
    """Means of the last ``n`` rows (the latest included) and the number of all rows."""
    w = Window.partitionBy(*entity).orderBy(*[F.col(c).desc() for c in order])
    ranked = df.withColumn("_rn", F.row_number().over(w))
    means = [F.avg(F.when(F.col("_rn") <= n, F.col(c))).alias(f"form_{c}") for c in columns]
    return ranked.groupBy(*entity).agg(*means, F.count("*").alias("games"))
