"""Null-safe scalar expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_not(condition: Column) -> Column:
    """Negation in which an unknown condition counts as false."""
    return ~F.coalesce(condition, F.lit(False))


def at_least(x: Column, low: float) -> Column:
    """Clip from below; null stays null (``greatest`` would give ``low``)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def ratio(kills: Column, assists: Column, deaths: Column) -> Column:
    return (kills + assists) / at_least(deaths, 1.0)


def clip_probability(p: Column, eps: float = 1e-15) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def expected(difference: Column) -> Column:
    """Logistic expectation of a rating difference (400 points are a factor of ten)."""
    return 1 / (1 + F.pow(F.lit(10.0), -difference / 400))


def log_loss(y: Column, p: Column) -> Column:
    q = clip_probability(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def lookup(key: Column, table: Mapping[str, str], default: str = "OTHER") -> Column:
    """Dictionary lookup; null and unknown keys give the default."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(entries, key), F.lit(default))


def is_major(region: Column, major: Iterable[str]) -> Column:
    return F.coalesce(region.isin(*major), F.lit(False))


def crosses(a: Column, b: Column, major: Iterable[str]) -> Column:
    """Both regions are major and differ."""
    major = list(major)
    return is_major(a, major) & is_major(b, major) & (a != b)


def bucket(event: Column, cross: Column, home_a: Column, home_b: Column, event_region: Column) -> Column:
    """First that holds: international event, mixed regional field, intra-league, cross-league."""
    return (
        F.when(event, "intl_event").when(cross, "regional_mixed").when((home_a == home_b) & (home_a == event_region), "intra_league").otherwise("cross_league_other")
    )


def lenient_number(text: Column) -> Column:
    return text.try_cast("double")


def lenient_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def hash_draw(seed: int, replicate: Column, i: Column, n: Column) -> Column:
    """Deterministic draw from 0..n-1 by md5; the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), i.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % n
