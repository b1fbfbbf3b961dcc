"""The contest model on the star schema, the same in Spark and in SQL.

An order is a game, its line status the side, its return flag the role; the supplier of the
first line is the player, the brand of a side's first role its team.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import crosses, is_major
from ..operators.pairing import first_rows, modal, paired, pivot_first
from ..sources.tables import drop, written

ROLES = ("A", "N", "R")
MAJOR = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
STATS = ("quantity", "price", "discount", "tax", "revenue")
#: Whether plans built now rate all games as one ordered history instead of one pool per year and event.
WHOLE: ContextVar[bool] = ContextVar("whole", default=False)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def players(spark: SparkSession, d: str) -> DataFrame:
    """One row per game, side and role. Lines are dealt by order, which serves the join with orders, too."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    li = first_rows(li.repartition("l_orderkey"), ["l_orderkey", "l_linestatus", "l_returnflag"], ["l_linenumber", "l_suppkey", "l_partkey"])
    leagues = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders, part = table(spark, d, "orders"), table(spark, d, "part")
    j = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(leagues, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.col("l_orderkey").alias("gameid"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("event"),
        F.when(F.col("l_linestatus") == "O", "Blue").otherwise("Red").alias("side"), F.col("l_returnflag").alias("position"),
        F.col("l_suppkey").alias("player"), F.col("r_name").alias("league"), F.col("p_brand").alias("brand"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )


def teams(p: DataFrame) -> DataFrame:
    """One row per game and side: team, league, revenue and mean stats, lineup. Rows are dealt by
    game, so pairing the sides needs no further shuffle."""
    first = F.struct("position", "player")
    return p.repartition("gameid").groupBy("gameid", "side").agg(
        F.first("date").alias("date"), F.first("event").alias("event"), F.min_by("brand", first).alias("team"), F.min_by("league", first).alias("league"),
        F.sum("revenue").alias("revenue"), F.avg("quantity").alias("avg_quantity"), F.avg("price").alias("avg_price"), F.avg("discount").alias("avg_discount"),
        F.avg("tax").alias("avg_tax"), F.array_sort(F.collect_set("player")).alias("lineup"), F.count("*").alias("n_roles"),
    )


def games(t: DataFrame) -> DataFrame:
    """Two-sided games between different teams, with the home region of each team and flags."""
    home = modal(t, ["team"], "league", "home")
    g = paired(t, "gameid", "side", "Blue", "Red", ["date", "event", "team", "league", "revenue", "lineup"])
    g = g.filter(F.col("blue_team") != F.col("red_team"))
    g = g.join(home.withColumnsRenamed({"team": "blue_team", "home": "blue_home"}), "blue_team", "left").join(home.withColumnsRenamed({"team": "red_team", "home": "red_home"}), "red_team", "left")

    def region(c: str):
        return F.when(is_major(F.col(c), MAJOR), F.col(c)).otherwise("OTHER")

    return g.select(
        "gameid", F.col("blue_date").alias("date"), F.col("blue_event").alias("event"), "blue_team", "red_team", "blue_league", "red_league", "blue_home", "red_home",
        "blue_lineup", "red_lineup", region("blue_league").alias("blue_region"), region("red_league").alias("red_region"),
        crosses(F.col("blue_league"), F.col("red_league"), MAJOR).alias("cross_region"),
        (F.col("blue_revenue") >= F.col("red_revenue")).cast("int").alias("target"),
        (F.lit("all") if WHOLE.get() else F.concat_ws("/", F.year("blue_date"), "blue_event")).alias("pool"),
    )


def lineups(p: DataFrame) -> DataFrame:
    return pivot_first(p, ["gameid", "side"], "position", ROLES, ["player"], ["player"])


def stream(spark: SparkSession, d: str) -> DataFrame:
    return games(teams(players(spark, d)))


#: What ``games`` reads of ``teams``.
TEAM_COLUMNS = ("gameid", "side", "date", "event", "team", "league", "revenue", "lineup")


def written_games(spark: SparkSession, d: str, form: Callable[[DataFrame], DataFrame] = lambda g: g, p: DataFrame | None = None, lineups: bool = True) -> DataFrame:
    """``form`` of the stream's games, written. The rows of teams, which games and homes both come
    from, are worked out once (of ``p``, if there are players already) and deleted at the end."""
    columns = [c for c in TEAM_COLUMNS if lineups or c != "lineup"]
    t = written(teams(players(spark, d) if p is None else p).select(*columns), "teams")
    out = written(form(games(t if lineups else t.withColumn("lineup", F.lit(None).cast("array<bigint>")))), "games")
    drop(t)
    return out


def ladder_games(g: DataFrame, by_player: bool = False) -> DataFrame:
    """Games in the form that ratings replay."""
    sides = ("blue_lineup", "red_lineup") if by_player else (F.array("blue_team"), F.array("red_team"))
    cast = [(F.col(s) if isinstance(s, str) else s).cast("array<string>") for s in sides]
    return g.select("pool", "date", "gameid", cast[0].alias("blue"), cast[1].alias("red"), "blue_region", "red_region", F.col("cross_region").alias("cross"), "target")


def rated_games(g: DataFrame) -> DataFrame:
    """Games for ladders of teams and of lineups together."""
    lineups = {f"{side}_lineup": F.col(f"{side}_lineup").cast("array<string>") for side in ("blue", "red")}
    return g.withColumns(lineups).select(
        "pool", "date", "gameid", F.array("blue_team").cast("array<string>").alias("blue"), F.array("red_team").cast("array<string>").alias("red"), *lineups, "blue_region", "red_region", F.col("cross_region").alias("cross"), "target"
    )


def over_history(query: Callable) -> Callable:
    """The query with ratings that are carried through all games in order of (date, gameid)."""

    def run(spark: SparkSession, d: str, *args, **kwargs):
        token = WHOLE.set(True)
        try:
            return query(spark, d, *args, **kwargs)
        finally:
            WHOLE.reset(token)

    return run


_MAJOR = ", ".join(f"'{m}'" for m in MAJOR)
SQL = f"""
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus, l_returnflag ORDER BY l_linenumber, l_suppkey, l_partkey) AS rn FROM lineitem),
players AS (
  SELECT l_orderkey AS gameid, o_orderdate AS date, o_orderpriority AS event, CASE WHEN l_linestatus = 'O' THEN 'Blue' ELSE 'Red' END AS side,
         l_returnflag AS position, l_suppkey AS player, r_name AS league, p_brand AS brand, l_quantity AS quantity, l_extendedprice AS price,
         l_discount AS discount, l_tax AS tax, l_extendedprice * (1 - l_discount) AS revenue
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
  WHERE rn = 1),
teams AS (
  SELECT gameid, side, min(date) AS date, min(event) AS event, first(brand ORDER BY position, player) AS team, first(league ORDER BY position, player) AS league,
         sum(revenue) AS revenue, avg(quantity) AS avg_quantity, avg(price) AS avg_price, avg(discount) AS avg_discount, avg(tax) AS avg_tax,
         list_sort(list_distinct(list(player))) AS lineup, count(*) AS n_roles
  FROM players GROUP BY gameid, side),
homes AS (
  SELECT team, league AS home FROM (
    SELECT team, league, row_number() OVER (PARTITION BY team ORDER BY count(*) DESC, league) AS rn FROM teams GROUP BY team, league) WHERE rn = 1),
games AS (
  SELECT b.gameid, b.date, b.event, b.team AS blue_team, r.team AS red_team, b.league AS blue_league, r.league AS red_league,
         hb.home AS blue_home, hr.home AS red_home, b.lineup AS blue_lineup, r.lineup AS red_lineup,
         CASE WHEN b.league IN ({_MAJOR}) THEN b.league ELSE 'OTHER' END AS blue_region,
         CASE WHEN r.league IN ({_MAJOR}) THEN r.league ELSE 'OTHER' END AS red_region,
         b.league IN ({_MAJOR}) AND r.league IN ({_MAJOR}) AND b.league <> r.league AS cross_region,
         CASE WHEN b.revenue >= r.revenue THEN 1 ELSE 0 END AS target, year(b.date) || '/' || b.event AS pool
  FROM (SELECT * FROM teams WHERE side = 'Blue') b JOIN (SELECT * FROM teams WHERE side = 'Red') r ON b.gameid = r.gameid AND b.team <> r.team
       LEFT JOIN homes hb ON hb.team = b.team LEFT JOIN homes hr ON hr.team = r.team)"""


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([SQL.strip(), *ctes]) + "\n" + body


def history_sql(text: str) -> str:
    """The SQL of ``over_history``: all games in one pool."""
    pool = "year(b.date) || '/' || b.event AS pool"
    assert pool in text
    return text.replace(pool, "'all' AS pool")
