"""A store of ratings that follows games as they come in, late ones included.

Every call replays, for each pool, the games after the last stored slice that ends before its first
new game, starting from the ratings at that slice's end. New games at the end thus cost themselves
alone; a late game costs what was played since the slice before it. What is superseded stays in
place and is outdated by a small table of starts, which is written last and so makes a call count
as a whole or not at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import drop, written
from .ratings import COLUMNS, History, Ladder, _tell_games
from .temporal import as_of

_AT = "struct<date:timestamp,gameid:bigint>"


@dataclass(frozen=True)
class Advance:
    """What a call did: games that were new, and games that were rated (new ones and old ones again)."""

    new: int
    replayed: int


class RatingStore:
    """Ratings of one ladder at ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, ladder: Ladder, size: int = 50_000):
        self.spark, self.path, self.ladder, self.size = spark, path.rstrip("/"), ladder, size

    def _starts(self) -> DataFrame | None:
        """pool, call, start: the slice from which a call wrote a pool anew; a row per pool and call."""
        try:
            return self.spark.read.parquet(f"{self.path}/starts")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _valid(self, name: str) -> DataFrame:
        """Rows of a stored table that no later call has replaced."""
        starts = self._starts()
        if starts is None:
            raise ValueError(f"nothing stored at {self.path}")
        later = Window.partitionBy("pool").orderBy(F.desc("call")).rowsBetween(Window.unboundedPreceding, -1)
        limits = starts.select("pool", "call", F.min("start").over(later).alias("_limit"))
        rows = self.spark.read.parquet(f"{self.path}/{name}").join(limits, ["pool", "call"])
        return rows.filter(F.col("_limit").isNull() | (F.col("slice") < F.col("_limit"))).drop("_limit", "call")

    def games(self) -> DataFrame:
        return self._valid("games")

    def rated(self) -> DataFrame:
        """pool, gameid, p, diff, target of every stored game, as a replay of all of them gives."""
        return self._valid("rated").drop("slice")

    def slices(self) -> DataFrame:
        """pool, slice, last: the last game (date, gameid) of each slice."""
        return self.games().groupBy("pool", "slice").agg(F.max(F.struct("date", "gameid")).alias("last"))

    def intervals(self) -> DataFrame:
        """pool, kind, name, rating, since, until: a member's rating from the end of the slice that
        moved it (its last game) to the end of the next one that does; null until is open."""
        member = Window.partitionBy("pool", "kind", "name").orderBy("since")
        moved = self._valid("moved").join(self.slices(), ["pool", "slice"])
        return moved.select("pool", "kind", "name", "rating", F.col("last").alias("since")).withColumn("until", F.lead("since").over(member))

    def ratings_as_of(self, requests: DataFrame) -> DataFrame:
        """``requests`` (pool, kind, name, date and more) with ``rating``: that of the last slice that
        ended before the date; unseen members have the base."""
        known = self.intervals().select("pool", "kind", "name", F.col("since.date").alias("date"), "since", "rating")
        out = as_of(requests, known, ["pool", "kind", "name"], ["date"], ["date", "since"], ["rating"])
        return out.withColumn("rating", F.coalesce("rating", F.lit(self.ladder.base)))

    def advance(self, games: DataFrame) -> Advance:
        """Add games (``COLUMNS``; none of them stored before) and bring all ratings up to date."""
        new, starts = written(games.select(*COLUMNS), "new"), self._starts()
        n_new = new.count()
        if not n_new:
            drop(new)
            return Advance(0, 0)
        first = new.groupBy("pool").agg(F.min(F.struct("date", "gameid")).alias("_first"))
        if starts is None:
            call, todo, state = 0, new, self.spark.createDataFrame([], "pool string, point int, kind string, name string, rating double")
            bounds = first.select("pool", F.lit(0).alias("start"))
        else:
            call = starts.agg(F.max("call")).first()[0] + 1
            before = self.slices().join(first, "pool").filter(F.col("last") < F.col("_first")).groupBy("pool").agg(F.max("slice").alias("_kept"))
            bounds = first.join(before, "pool", "left").select("pool", (F.coalesce("_kept", F.lit(-1)) + 1).alias("start"))
            bounds = written(bounds, "bounds")
            again = self.games().join(bounds, "pool").filter(F.col("slice") >= F.col("start"))
            todo = again.select(*COLUMNS).unionByName(new)
            kept = self._valid("moved").join(bounds, "pool").filter(F.col("slice") < F.col("start"))
            state = kept.groupBy("pool", "kind", "name").agg(F.max_by("rating", "slice").alias("rating")).withColumn("point", F.lit(0))
        state = written(state.select("pool", "point", "kind", "name", "rating"), "ratings")
        history = History(todo, self.size, start=state)
        out = history.fold([self.ladder], _tell_games).join(bounds, "pool").withColumn("slice", F.col("step") + F.col("start"))
        placed = history.all_slices().join(bounds, "pool").withColumn("slice", F.col("slice") + F.col("start"))
        for name, df in (
            ("games", placed.select(*COLUMNS, "slice")),
            ("rated", out.filter("kind = 'told'").select("pool", "gameid", "p", "diff", "target", "slice")),
            ("moved", out.filter("kind <> 'told'").select("pool", "kind", "name", "rating", "slice")),
        ):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/call={call}")
        replayed = history.games.count()
        bounds.write.mode("overwrite").parquet(f"{self.path}/starts/call={call}")
        history.close()
        drop(new, state, *([bounds] if starts is not None else []))
        return Advance(n_new, replayed)
