"""Classification metrics and tests as aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import log_loss
from .draws import PASS, Times, digests
from .temporal import average_rank


def point_metrics(y: Column, p: Column) -> list[Column]:
    """n, accuracy, log_loss, brier, baseline (the better constant)."""
    hit = ((p >= 0.5).cast("int") == y).cast("double")
    base = F.avg(y.cast("double"))
    return [
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(log_loss(y, p)).alias("log_loss"),
        F.avg(F.pow(p - y, 2)).alias("brier"), F.greatest(base, 1 - base).alias("baseline"),
    ]


def auc(df: DataFrame, y: str, p: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by rank sums; null where one class is absent."""
    ranked = average_rank(df.select(*groups, y, p), p, groups, "_rank")
    pos, n = F.sum(F.col(y).cast("double")), F.count("*")
    value = (F.sum(F.when(F.col(y) == 1, F.col("_rank"))) - pos * (pos + 1) / 2) / (pos * (n - pos))
    return ranked.groupBy(*groups).agg(F.when((pos > 0) & (n > pos), value).alias("auc"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean prediction and outcome of equal bins; an edge belongs to the lower bin."""
    b = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    both = df.select(F.col(y).alias("y"), (F.col(p) >= 0.5).cast("int").alias("z")).select("y", "z", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    tp = F.sum(((F.col("y") == F.col("label")) & (F.col("z") == F.col("label"))).cast("double"))
    said, true = (F.sum((F.col(c) == F.col("label")).cast("double")) for c in ("z", "y"))
    out = both.groupBy("label").agg(tp.alias("tp"), said.alias("said"), true.alias("true"))
    zero = F.lit(0.0)
    precision, recall = (F.when(F.col(c) > 0, F.col("tp") / F.col(c)).otherwise(zero) for c in ("said", "true"))
    out = out.select("label", precision.alias("precision"), recall.alias("recall"), F.col("true").cast("long").alias("support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(zero)
    return out.withColumn("f1", f1)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p from the discordant counts; 1.0 if there are none."""
    n, m = b + c, F.least(b, c)
    start = -n * F.log(F.lit(2.0))
    state = F.struct(start.cast("double").alias("term"), F.exp(start).cast("double").alias("total"))
    steps = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<long>"))
    walked = F.aggregate(
        steps, state,
        lambda a, i: F.struct((a["term"] + F.log((n - i + 1) / i)).alias("term"), (a["total"] + F.exp(a["term"] + F.log((n - i + 1) / i))).alias("total")),
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * walked["total"]))


#: Draws that one md5 of 32 digits gives.
DRAWS = 4
#: Groups whose sums a task holds at once.
HELD_GROUPS = 256


def poisson_steps() -> list[str]:
    """Eight hexadecimal digits from which on a draw counts once, twice and so on: the cumulated
    Poisson distribution of mean 1, up to what 32 bits can tell."""
    steps, term, total = [], math.exp(-1.0), 0.0
    while (limit := math.floor((total := total + term) * 2**32)) < 2**32 - 1:
        steps.append(f"{limit:08x}")
        term /= len(steps)
    return steps


def bootstrap(df: DataFrame, value: str | Sequence[str], key: str, replicates: int, seed: int, groups: Sequence[str] = (), least: int = 30) -> DataFrame:
    """Percentile interval of the resampled mean: lo, hi, replicates, and ``measure`` (the column)
    if there are several values, which then share their resamples. Groups under ``least`` rows are
    left out.

    How often a replicate holds a row is a Poisson number of mean 1, by a hash of seed, replicate
    and ``key``: the resampling of large tables, in which rows need no numbers and no second row.
    Digests are worked out for many rows at once in tasks. Sums are combined where rows lie, so what
    is shuffled is replicates x groups x parts, not rows.
    Null values count as 0; keys tell rows apart, equal ones are drawn together.
    """
    values = [value] if isinstance(value, str) else list(value)
    group = F.to_json(F.struct(*groups)) if groups else F.lit("")
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    rows = df.select(*groups, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, v in enumerate(values)])
    rows = rows.join(F.broadcast(sizes), list(groups)) if groups else rows.crossJoin(F.broadcast(sizes))
    prefixes = [f"{seed}|{r}|" for r in range(math.ceil(replicates / DRAWS))]
    steps = [int(x, 16) for x in poisson_steps()]
    width = 1 + len(values)  # the sum of times and those of times x value

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, held, waiting = Times(steps), {}, []

        def add():
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            codes = table.column("_group").combine_chunks().dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            order, found = digests(prefixes, table.column("_key").to_pylist())
            factors = np.stack([np.ones(len(code)), *(table.column(f"_x{i}").to_numpy() for i in range(len(values)))], axis=1)[order]
            mine = [(held.setdefault(n, np.zeros((len(prefixes), DRAWS, width))), np.flatnonzero(code[order] == k)) for k, n in enumerate(names)]
            mine = [(sums, at, factors[at]) for sums, at in mine]
            for r, digits in enumerate(found):
                count = times(digits).astype(np.float64)
                for sums, at, x in mine:
                    sums[r] += (count if len(mine) == 1 else count[:, at]) @ x

        def ended():
            for name, sums in held.items():
                flat = sums.reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(flat)), pa.array(np.arange(len(flat), dtype=np.int32)), *(pa.array(flat[:, i].copy()) for i in range(width))], ["_group", "rep", *(f"_s{i}" for i in range(width))])
            held.clear()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= PASS:
                add()
                if len(held) > HELD_GROUPS:
                    yield from ended()
        if sum(b.num_rows for b in waiting):
            add()
        yield from ended()

    drawn = rows.select(group.alias("_group"), "_key", *[f"_x{i}" for i in range(len(values))])
    sums = drawn.mapInArrow(draw, "_group string, rep int, " + ", ".join(f"_s{i} double" for i in range(width)))
    by_rep = sums.filter(F.col("rep") < replicates).groupBy("_group", "rep").agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(width)])
    each = F.array(*[F.struct(F.lit(v).alias("measure"), (F.col(f"_s{i + 1}") / F.nullif(F.col("_s0"), F.lit(0.0))).alias("mean")) for i, v in enumerate(values)])
    means = by_rep.select("_group", F.explode(each).alias("_m")).select("_group", "_m.*")
    out = means.groupBy("_group", "measure").agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"), F.count("*").alias("replicates"))
    out = sizes.select(*groups, group.alias("_group")).join(out, "_group").select(*groups, "measure", "lo", "hi", "replicates")
    return out.drop("measure") if isinstance(value, str) else out
