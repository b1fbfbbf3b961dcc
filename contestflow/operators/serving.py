"""Look-ups that serve predictions: name resolution, rosters, form, ratings with defaults."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class RequestError(ValueError):
    """A request that cannot be answered."""


def check_request(blue: str, red: str, window: int) -> None:
    if not 1 <= window <= 50:
        raise RequestError("window must be between 1 and 50")
    if blue.strip().lower() == red.strip().lower():
        raise RequestError("a team cannot meet itself")


def _characters(df: DataFrame, name: str, seen: Column) -> DataFrame:
    """``name``, its length ``_len`` and its characters ``_all``, numbered where they repeat."""
    letters = F.regexp_extract_all(seen, F.lit("(?s)."), F.lit(0))
    numbered = F.transform(letters, lambda x, i: F.concat(x, F.lit("\x1f"), F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    return df.select(name, F.size(letters).alias("_len"), numbered.alias("_all"))


def _candidates(asked: DataFrame, names: DataFrame, keep, fits, short: int, seen=lambda c: c) -> DataFrame:
    """Pairs (asked, n) that may be alike, by an equi-join on characters.

    Two names that are alike share a number of characters, counted with repeats. With all characters
    in one order, rarest first, such a pair shares one among the first ``keep(length)`` of each name,
    so only these are joined on. ``fits(asked length, length, shared)`` is then checked in full. Names
    of at most ``short`` characters may be alike without sharing any and meet through a mark of their own.
    """
    left, right = _characters(asked, "asked", seen(F.col("asked"))), _characters(names, "n", seen(F.col("n")))
    rare = right.select(F.explode("_all").alias("_token")).groupBy("_token").agg(F.count("*").alias("_freq"))

    def first(df: DataFrame, name: str) -> DataFrame:
        each = df.select(name, "_len", "_all", F.explode("_all").alias("_token")).join(rare, "_token", "left")
        ordered = each.groupBy(name).agg(F.first("_len").alias("_len"), F.first("_all").alias("_all"), F.array_sort(F.collect_list(F.struct(F.coalesce("_freq", F.lit(0)).alias("f"), F.col("_token").alias("t")))).alias("_by"))
        kept = ordered.select(name, "_len", "_all", F.explode(F.slice("_by", F.lit(1), keep(F.col("_len")))).alias("_k")).select(name, "_len", "_all", F.col("_k.t").alias("_token"))
        marked = df.filter(F.col("_len") <= short).select(name, "_len", "_all", F.lit("").alias("_token"))
        return kept.union(marked)

    a, b = first(left, "asked"), first(right, "n").withColumnsRenamed({"_len": "_len_n", "_all": "_all_n"})
    met = a.join(b, "_token").filter(fits(F.col("_len"), F.col("_len_n"), F.least("_len", "_len_n")))
    full = met.filter(fits(F.col("_len"), F.col("_len_n"), F.size(F.array_intersect("_all", "_all_n"))))
    return full.select("asked", "n").distinct()


def resolve(requests: DataFrame, catalog: DataFrame, known: DataFrame, name: str = "name", close: int = 5) -> DataFrame:
    """How each asked name is understood: exact, else ignoring case, else unsupported (known but
    not in the catalogue), else the nearest catalogue names by edit distance within ``close``.

    The catalogue has one row per served entity. Names within ``close`` edits share all but that many
    characters of the longer one, so pairs come from an equi-join on characters, whatever the
    numbers of names and requests.
    """
    asked = requests.select(F.trim(name).alias("asked")).filter("asked IS NOT NULL").distinct()
    names = catalog.select(F.col(name).alias("n")).filter("n IS NOT NULL").distinct()

    def fits(a: Column, b: Column, shared: Column) -> Column:
        return shared >= F.greatest(a, b) - close

    pairs = _candidates(asked, names, lambda n: F.lit(close + 1), fits, close, F.lower)
    distance = F.levenshtein(F.lower("n"), F.lower("asked"))
    pairs = pairs.filter(distance <= close)
    best = pairs.groupBy("asked").agg(
        F.max(F.when(F.col("n") == F.col("asked"), F.col("n"))).alias("exact"), F.min(F.when(F.lower("n") == F.lower("asked"), F.col("n"))).alias("any_case"),
        F.min_by("n", F.struct(distance, F.col("n"))).alias("nearest"),
    )
    others = known.select(F.col(name).alias("k")).join(asked, F.lower("k") == F.lower("asked")).groupBy("asked").agg(F.min("k").alias("outside"))
    j = requests.select(F.trim(name).alias("asked")).distinct().join(best, "asked", "left").join(others, "asked", "left")
    found = F.coalesce("exact", "any_case")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("any_case").isNotNull(), "case").when(F.col("outside").isNotNull(), "unsupported").when(F.col("nearest").isNotNull(), "suggested").otherwise("unknown")
    return j.select("asked", how.alias("how"), F.coalesce(found, F.when(F.col("outside").isNull(), F.col("nearest"))).alias("resolved"))


@F.pandas_udf(DoubleType())
def _alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of matching characters of two names, as close-match searches rate it."""
    for a, b in batches:
        yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def suggest(requests: DataFrame, catalog: DataFrame, name: str = "name", most: int = 5, least: float = 0.6) -> DataFrame:
    """asked, suggestions: up to ``most`` catalogue names that are alike by ``least`` or more, best
    first (ties: the greater name), for asked names that the catalogue lacks in any case.

    The ratio is at most twice the shared characters over all, which bounds lengths and says how
    many characters alike names share; only pairs that can reach ``least`` are compared.
    """
    asked = requests.select(F.trim(name).alias("asked")).filter("asked IS NOT NULL").distinct()
    names = catalog.select(F.col(name).alias("n")).filter("n IS NOT NULL").distinct()
    slack = 1e-9

    def keep(n: Column) -> Column:
        return (n - F.ceil(n * (least / (2 - least)) - slack) + 1).cast("int")

    def fits(a: Column, b: Column, shared: Column) -> Column:
        return 2.0 * shared >= least * (a + b) - slack

    pairs = _candidates(asked, names, keep, fits, 0).withColumn("_ratio", _alike("n", "asked"))
    ranked = pairs.filter(F.col("_ratio") >= least).groupBy("asked").agg(F.slice(F.sort_array(F.collect_list(F.struct("_ratio", "n")), asc=False), 1, most).alias("best"))
    served = names.join(asked, F.lower("n") == F.lower("asked")).select("asked").distinct()
    missing = requests.select(F.trim(name).alias("asked")).distinct().join(served, "asked", "left_anti")
    return missing.join(ranked, "asked", "left").select("asked", F.coalesce(F.array_join(F.transform("best", lambda x: x["n"]), ", "), F.lit("")).alias("suggestions"))


def parse_overrides(items: DataFrame, roles: Sequence[str], item: str = "item") -> DataFrame:
    """item, team, position, player, refused of texts ``team:role=player``.

    The first colon and the first equals sign part the text; roles are compared in upper case.
    Texts without ``role=`` and those of unknown roles are refused and name nobody; a null text is
    refused, too.
    """
    rest = F.regexp_replace(F.coalesce(item, F.lit("")), "^[^:]*:", "")
    at = F.instr(rest, "=")
    role = F.upper(F.trim(F.substring_index(rest, "=", 1)))
    refused = F.when(at == 0, "no role=player").when(~role.isin(*roles), "unknown role")
    parts = {"team": F.trim(F.substring_index(item, ":", 1)), "position": role, "player": F.trim(F.regexp_replace(rest, "(?s)^[^=]*=", ""))}
    return items.select(item, *[F.when(refused.isNull(), c).alias(n) for n, c in parts.items()], refused.alias("refused"))


def completeness(rosters: DataFrame, roles: Sequence[str]) -> DataFrame:
    """team, filled, complete: whether every role of a team's roster has a player."""
    filled = F.countDistinct(F.when(F.col("player").isNotNull() & F.col("position").isin(*roles), F.col("position")))
    return rosters.groupBy("team").agg(filled.alias("filled"), (filled == len(roles)).alias("complete"))


def with_default(df: DataFrame, state: DataFrame, key: str, base: float = 1500.0, into: str = "rating") -> DataFrame:
    """Saved rating of each row's member; unseen members have the base."""
    s = state.select(F.col("name").alias(key), F.col("rating").alias("_r"))
    return df.join(s, key, "left").withColumn(into, F.coalesce("_r", F.lit(base))).drop("_r")


def override(rosters: DataFrame, changes: DataFrame) -> DataFrame:
    """Rosters (team, position, player) with the players of ``changes`` in their place."""
    c = changes.select("team", "position", F.col("player").alias("_new"))
    return rosters.join(c, ["team", "position"], "full").select("team", "position", F.coalesce("_new", "player").alias("player"))
