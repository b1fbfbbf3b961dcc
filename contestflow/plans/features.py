"""Queries on scans, filters, pairing, windows and features, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import exprs as X
from ..operators import pairing as P
from ..operators import temporal as T
from ..sources.tables import RAW_SCHEMA, folder, read_raw, read_years, union_all, write_by_year
from . import matchmodel as M

def rounded(c, n):
    """Rounded a little off the half, since engines sum doubles in different orders."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(10.0 ** -(n + 3)), n)


def _events(spark, d):
    return M.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def scan_clean_rows(spark, d):
    """Equality, membership and both range policies on nulls; lenient number; casts."""
    o = M.table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")))
    o = o.filter(F.col("o_orderstatus").isin("F", "O") & (F.col("price").isNull() | (F.col("price") > 900))).dropna(subset=["o_custkey", "o_orderdate"])
    patch = X.lenient_number(F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".10")))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.round("price", 2).alias("price"), patch.alias("patch"), F.year("o_orderdate").cast("long").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


SCAN_SQL = """
SELECT o_orderkey, o_orderstatus AS status, round(price, 2) AS price, try_cast(substring(o_orderpriority, 1, 1) || '.10' AS DOUBLE) AS patch,
       year(o_orderdate)::BIGINT AS year, strftime(o_orderdate, '%Y-%m-%d') AS day
FROM (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price FROM orders)
WHERE o_orderstatus IN ('F', 'O') AND (price IS NULL OR price > 900) AND o_custkey IS NOT NULL AND o_orderdate IS NOT NULL"""


def null_dropping_range(spark, d):
    """The other policy: an unknown length is dropped; safe negation keeps unknown members."""
    o = M.table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")))
    return o.filter(F.col("price") > 900).agg(F.count("*").alias("kept_known")).crossJoin(
        o.withColumn("s", F.nullif("o_orderstatus", F.lit("P"))).filter(X.safe_not(F.col("s").isin("F"))).agg(F.count("*").alias("kept_not_f"))
    )


NULL_SQL = """
SELECT (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 900) AS kept_known,
       (SELECT count(*) FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') IN ('F'), false)) AS kept_not_f"""


def union_years(spark, d):
    o = M.table(spark, d, "orders")
    parts = [o.filter((F.col("o_orderdate") >= f"{y}-01-01") & (F.col("o_orderdate") < f"{y + 1}-01-01")) for y in (1996, 1997, 1998)]
    return union_all(parts).groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


UNION_SQL = "SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1998) GROUP BY 1"


#: The years that the file queries read of those they write.
READ_YEARS = (1996, 1997)


def csv_years(spark, d):
    """Yearly CSV files, written from the tables, read again for two years: a declared schema, a
    column subset, lenient dates and numbers."""
    p = M.players(spark, d).withColumn("year", F.year("date"))
    raw = {"gameid": F.col("gameid").cast("string"), "date": F.date_format("date", "yyyy-MM-dd HH:mm:ss"), "league": F.col("league"), "patch": F.concat(F.substring("event", 1, 1), F.lit(".5")), "side": F.col("side"), "position": F.col("position"), "playername": F.col("player").cast("string"), "teamname": F.col("brand"), "kills": F.col("quantity")}
    names = [f.name for f in StructType.fromDDL(RAW_SCHEMA)]
    path = folder(spark, "csv")
    p.select("year", *[raw.get(c, F.lit(None).cast("string")).alias(c) for c in names]).write.partitionBy("year").option("header", True).csv(path)
    years = read_raw(spark, [f"{path}/year={y}" for y in READ_YEARS], ["date", "league", "patch", "playername", "kills", "deaths"])
    return years.groupBy(F.year("date").cast("long").alias("year"), "league").agg(F.count("*").alias("n"), F.countDistinct("playername").alias("players"), F.round(F.sum("kills"), 2).alias("kills"), F.round(F.avg("patch"), 6).alias("patch"), F.count("deaths").alias("deaths"))


CSV_SQL = M.sql(f"SELECT year(date)::BIGINT AS year, league, count(*) AS n, count(DISTINCT player) AS players, round(sum(quantity), 2) AS kills, round(avg(substring(event, 1, 1)::INT + 0.5), 6) AS patch, 0::BIGINT AS deaths FROM players WHERE year(date) IN {READ_YEARS} GROUP BY ALL")


def partitioned_years(spark, d):
    """A dataset partitioned by year, read for two years: the filter prunes folders."""
    path = folder(spark, "years")
    write_by_year(M.players(spark, d).select("gameid", "date", "side", "league", "revenue"), path)
    return read_years(spark, path, READ_YEARS).groupBy(F.col("year").cast("long").alias("year"), "side").agg(F.count("*").alias("n"), F.countDistinct("gameid").alias("games"))


YEARS_SQL = M.sql(f"SELECT year(date)::BIGINT AS year, side, count(*) AS n, count(DISTINCT gameid) AS games FROM players WHERE year(date) IN {READ_YEARS} GROUP BY ALL")


def policy_filter_coverage(spark, d):
    p = M.players(spark, d)
    full = P.with_distinct_values(p, ["gameid", "side"], "position", 3)

    def row(df, name):
        return df.agg(F.lit(name).alias("policy"), F.count("*").alias("rows"), F.countDistinct("gameid").alias("games"), F.countDistinct("player").alias("players"))

    return row(p, "any").union(row(full, "complete"))


POLICY_SQL = M.sql(
    "SELECT 'any' AS policy, count(*) AS rows, count(DISTINCT gameid) AS games, count(DISTINCT player) AS players FROM players UNION ALL "
    "SELECT 'complete', count(*), count(DISTINCT gameid), count(DISTINCT player) FROM players SEMI JOIN (SELECT gameid, side FROM teams WHERE n_roles = 3) f USING (gameid, side)"
)


def two_sided_games(spark, d):
    return P.with_distinct_values(M.players(spark, d), ["gameid"], "side", 2).groupBy("gameid").agg(F.count("*").alias("rows"))


def full_lineups(spark, d):
    return P.with_distinct_values(M.players(spark, d), ["gameid", "side"], "position", 3).select("gameid", "side", "position", "player")


def derived_ratio_kda(spark, d):
    li = M.table(spark, d, "lineitem").withColumn("deaths", F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") - 1))
    k = X.ratio(F.col("l_quantity"), F.col("l_discount"), F.col("deaths"))
    return li.groupBy("l_returnflag").agg(F.round(F.avg(k), 6).alias("kda"), F.count(k).alias("known"), F.count("*").alias("n"))


KDA_SQL = """
SELECT l_returnflag, round(avg((l_quantity + l_discount) / dd), 6) AS kda, count(dd) AS known, count(*) AS n
FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN greatest(l_linenumber - 1, 1) END::DOUBLE AS dd FROM lineitem) GROUP BY 1"""

_REGIONS = {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU"}


def region_lookup_default(spark, d):
    c = M.teams(M.players(spark, d))
    return c.groupBy(X.lookup(F.col("league"), _REGIONS).alias("code")).agg(F.count("*").alias("n"))


LOOKUP_SQL = M.sql("SELECT CASE league WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU' ELSE 'OTHER' END AS code, count(*) AS n FROM teams GROUP BY 1")


def cross_region_flag(spark, d):
    return M.stream(spark, d).groupBy("cross_region").agg(F.count("*").alias("n"), F.sum("target").alias("blue_wins"))


def bucketed(g):
    return g.withColumn("bucket", X.bucket(F.col("event") == "1-URGENT", F.col("cross_region"), F.col("blue_home"), F.col("red_home"), F.col("blue_league")))


BUCKET = """CASE WHEN event = '1-URGENT' THEN 'intl_event' WHEN cross_region THEN 'regional_mixed'
 WHEN blue_home = red_home AND blue_home = blue_league THEN 'intra_league' ELSE 'cross_league_other' END"""


def bucket_case(spark, d):
    return bucketed(M.stream(spark, d)).groupBy("bucket").agg(F.count("*").alias("n"))


def unmapped_labels(spark, d):
    """Home regions of either side that no major list has."""
    g = M.stream(spark, d)
    labels = g.select(F.col("blue_league").alias("label")).union(g.select("red_league")).distinct()
    return labels.filter(X.safe_not(F.col("label").isin(*M.MAJOR)) & F.col("label").isNotNull())


def team_frame_means(spark, d):
    p = M.players(spark, d)
    means = p.groupBy("gameid", "side").agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("quantity", "price", "discount", "tax")])
    return M.teams(p).select("gameid", "side", "team").join(means, ["gameid", "side"], "left")


def modal_home_region(spark, d):
    return P.modal(M.teams(M.players(spark, d)), ["team"], "league", "home")


def pivot_lineups(spark, d):
    return M.lineups(M.players(spark, d))


def pivot_role_stats(spark, d):
    """Role columns of trailing means and career games: one pivot, no join per role."""
    p = _player_windows(spark, d)
    stats = P.pivot_first(p, ["gameid", "side"], "position", M.ROLES, ["player"], ["roll_quantity", "roll_price", "career"])
    return stats.select("gameid", "side", *[F.round(c, 6).alias(c) if "roll" in c else F.col(c) for c in stats.columns[2:]])


_ROLE_STATS = [f"{r}_{c}" for r in M.ROLES for c in ("roll_quantity", "roll_price", "career")]


def role_differences(spark, d, p=None):
    """Blue minus red of every role's trailing means and career games, one row per two-sided game."""
    stats = P.pivot_first(_player_windows(spark, d, p), ["gameid", "side"], "position", M.ROLES, ["player"], ["roll_quantity", "roll_price", "career"])
    g = P.differences(P.paired(stats, "gameid", "side", "Blue", "Red", _ROLE_STATS), _ROLE_STATS)
    return g.select("gameid", *[F.round(f"diff_{c}", 6).alias(f"diff_{c}") if "roll" in c else F.col(f"diff_{c}") for c in _ROLE_STATS])


def _player_windows(spark, d, p=None):
    p = M.players(spark, d) if p is None else p
    order = ["date", "gameid", "side", "position"]
    p = T.trailing_mean(p, ["quantity", "price"], ["player"], order, 10, 3)
    return T.prior_count(p, ["player"], order, "career")


_PLAYER_SQL = """
w AS (
  SELECT *, CASE WHEN count(quantity) OVER f >= 3 THEN avg(quantity) OVER f END AS roll_quantity,
         CASE WHEN count(price) OVER f >= 3 THEN avg(price) OVER f END AS roll_price,
         row_number() OVER (PARTITION BY player ORDER BY date, gameid, side, position) - 1 AS career
  FROM players WINDOW f AS (PARTITION BY player ORDER BY date, gameid, side, position ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""
_PIVOT = ", ".join(
    f"round(max(roll_quantity) FILTER (position = '{r}'), 6) AS \"{r}_roll_quantity\", round(max(roll_price) FILTER (position = '{r}'), 6) AS \"{r}_roll_price\", max(career) FILTER (position = '{r}') AS \"{r}_career\""
    for r in M.ROLES
)


def trailing_mean_player(spark, d):
    return _player_windows(spark, d).select("gameid", "side", "position", "player", F.round("roll_quantity", 6).alias("roll_quantity"), F.round("roll_price", 6).alias("roll_price"), "career")


def trailing_mean_team(spark, d):
    t = T.trailing_mean(M.teams(M.players(spark, d)), ["revenue", "avg_quantity", "avg_discount"], ["team"], ["date", "gameid", "side"], 10, 5, split=True)
    return t.select("gameid", "side", "team", *[rounded(f"roll_{c}", 4).alias(f"roll_{c}") for c in ("revenue", "avg_quantity", "avg_discount")])


_TEAM_ROLL = ", ".join(f"round(CASE WHEN count({c}) OVER f >= 5 THEN avg({c}) OVER f END + 1e-7, 4) AS roll_{c}" for c in ("revenue", "avg_quantity", "avg_discount"))
TEAM_SQL = M.sql(f"SELECT gameid, side, team, {_TEAM_ROLL} FROM teams WINDOW f AS (PARTITION BY team ORDER BY date, gameid, side ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")


def trailing_mean_events(spark, d):
    """The same operator on another entity and clock, with nulls in the value."""
    e = _events(spark, d).withColumn("v", F.when(F.col("value") < 50, F.col("value")))
    return T.trailing_mean(e, ["v"], ["user_id"], ["ts", "event_id"], 10, 5).select("event_id", F.round("roll_v", 6).alias("roll_v"))


EVENT_ROLL_SQL = """
SELECT event_id, round(CASE WHEN count(v) OVER f >= 5 THEN avg(v) OVER f END, 6) AS roll_v
FROM (SELECT *, CASE WHEN value < 50 THEN value END AS v FROM events)
WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


def pair_blue_red(spark, d):
    g = P.pair_sides(M.teams(M.players(spark, d)), "gameid", "side", "Blue", "Red", ["team", "revenue", "n_roles"])
    return P.differences(g, ["revenue", "n_roles"]).select("gameid", "blue_team", "red_team", F.round("diff_revenue", 4).alias("diff_revenue"), "diff_n_roles")


def game_stream_home(spark, d):
    """Game stream with trailing-mode home leagues joined for both sides."""
    t = T.trailing_mode(M.teams(M.players(spark, d)), "league", ["team"], ["date", "gameid", "side"], 20, "home")
    g = P.pair_sides(t, "gameid", "side", "Blue", "Red", ["team", "home"])
    return g.select("gameid", "blue_team", "red_team", "blue_home", "red_home")


def _mode_sql(source: str, entity: str, value: str, order: str, keys: str, w: int) -> tuple[str, ...]:
    return (
        f"s0 AS (SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY {order}) AS i FROM {source})",
        f"s1 AS (SELECT *, lag(i) OVER (PARTITION BY {entity}, {value} ORDER BY i) AS pi FROM s0)",
        f"s2 AS (SELECT *, max(CASE WHEN pi IS NULL OR i - pi > {w} THEN i END) OVER (PARTITION BY {entity}, {value} ORDER BY i ROWS UNBOUNDED PRECEDING) AS st FROM s1)",
        f"s3 AS (SELECT a.{entity} AS e, a.i, b.{value} AS v, row_number() OVER (PARTITION BY a.{entity}, a.i ORDER BY count(*) DESC, max(b.st)) AS rk FROM s2 a JOIN s2 b ON a.{entity} = b.{entity} AND b.i BETWEEN a.i - {w} AND a.i - 1 GROUP BY a.{entity}, a.i, b.{value})",
        f"modes AS (SELECT {keys}, s2.{entity}, coalesce(v, {value}) AS home FROM s2 LEFT JOIN s3 ON s3.e = s2.{entity} AND s3.i = s2.i AND rk = 1)",
    )


_TEAM_MODE = _mode_sql("teams", "team", "league", "date, gameid, side", "gameid, side", 20)


def trailing_mode_home(spark, d):
    return T.trailing_mode(M.teams(M.players(spark, d)), "league", ["team"], ["date", "gameid", "side"], 20, "home", split=True).select("gameid", "side", "team", "home")


def trailing_mode_events(spark, d):
    return T.trailing_mode(_events(spark, d), "event_type", ["user_id"], ["ts", "event_id"], 20, "home").select("event_id", "user_id", "home")


def lookup_by_id(spark, d):
    """Left join of flags by id; missing ids count as false."""
    g = M.stream(spark, d).select("gameid", "cross_region")
    o = M.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    j = o.join(g, F.col("o_orderkey") == F.col("gameid"), "left").withColumn("cross", F.coalesce("cross_region", F.lit(False)))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("cross").cast("long")).alias("cross"))


def shared_games(spark, d):
    """Games that two policies share and that only one has."""
    t = M.teams(M.players(spark, d))
    a, b = t.filter("side = 'Blue'").select("gameid"), t.filter("side = 'Red' and n_roles >= 2").select("gameid")
    return a.intersect(b).agg(F.count("*").alias("shared")).crossJoin(a.exceptAll(b).agg(F.count("*").alias("only_first")))


def semi_by_ids(spark, d):
    ids = M.table(spark, d, "orders").filter("o_orderdate >= '1998-01-01'").select(F.col("o_orderkey").alias("gameid"))
    return M.players(spark, d).join(ids, "gameid", "left_semi").groupBy("league").agg(F.count("*").alias("n"))


def _roster(spark, d, before=None):
    p = M.players(spark, d).join(M.teams(M.players(spark, d)).select("gameid", "side", "team"), ["gameid", "side"])
    p = p.filter(F.col("date") < before) if before else p
    return T.latest(p, ["team", "position"], "player", ["date", "gameid", "side"], "player")


def latest_roster(spark, d):
    return _roster(spark, d)


def latest_roster_asof(spark, d):
    return _roster(spark, d, "1997-07-01")


def roster_as_of_games(spark, d):
    """Every team's roster as it was known before each of its games: who last had each role, on an
    earlier day. One pass answers all (team, role, day)."""
    p = M.players(spark, d)
    t = M.teams(p).select("gameid", "side", "team", "date")
    events = p.join(t.drop("date"), ["gameid", "side"]).select("team", "position", "date", "gameid", "side", "player")
    asked = t.withColumn("position", F.explode(F.array(*[F.lit(r) for r in M.ROLES])))
    out = T.as_of(asked, events.withColumnRenamed("gameid", "game"), ["team", "position"], ["date"], ["date", "game", "side"], ["player"])
    return out.select("gameid", "side", "team", "position", "player")


AS_OF_SQL = M.sql(
    "SELECT a.gameid, a.side, a.team, a.position, e.player FROM asked a ASOF LEFT JOIN last_of_day e ON a.team = e.team AND a.position = e.position AND a.date > e.date",
    "events AS (SELECT t.team, p.position, p.date, p.gameid, p.side, p.player FROM players p JOIN teams t USING (gameid, side))",
    "last_of_day AS (SELECT team, position, date, max_by(player, (gameid, side)) AS player FROM events GROUP BY ALL)",
    f"asked AS (SELECT gameid, side, team, date, unnest({list(M.ROLES)}) AS position FROM teams)",
)


def _roster_sql(where: str = "") -> str:
    return M.sql(
        f"SELECT team, position, player FROM (SELECT t.team, p.position, p.player, row_number() OVER (PARTITION BY t.team, p.position ORDER BY p.date DESC, p.gameid DESC, p.side DESC) AS rn FROM players p JOIN teams t USING (gameid, side) {where}) WHERE rn = 1"
    )


def roster_continuity(spark, d):
    t = M.teams(M.players(spark, d))
    return T.overlap_with_previous(t, F.col("lineup"), ["team"], ["date", "gameid", "side"], "continuity", split=True).select("gameid", "side", "team", "continuity")


CONTINUITY = "cont AS (SELECT gameid, side, team, CASE WHEN before IS NOT NULL THEN len(list_intersect(lineup, before))::BIGINT END AS continuity FROM (SELECT *, lag(lineup) OVER (PARTITION BY team ORDER BY date, gameid, side) AS before FROM teams))"


def prior_games_coverage(spark, d):
    """Share of games in which both teams have ten earlier games on either side."""
    return _prior(M.stream(spark, d)).agg(F.count("*").alias("games"), F.round(F.avg(((F.col("blue_prior") >= 10) & (F.col("red_prior") >= 10)).cast("double")), 6).alias("coverage"))


def _prior(g):
    sides = g.select("gameid", "date", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("blue_team").alias("team")), F.struct(F.lit(1).alias("s"), F.col("red_team").alias("team")))).alias("x")).select("gameid", "date", "x.*")
    counted = T.prior_count(sides, ["team"], ["date", "gameid"])
    wide = counted.groupBy("gameid").agg(F.max(F.when(F.col("s") == 0, F.col("prior"))).alias("blue_prior"), F.max(F.when(F.col("s") == 1, F.col("prior"))).alias("red_prior"))
    return g.join(wide, "gameid")


PRIOR = """
sides AS (SELECT gameid, date, 0 AS s, blue_team AS team FROM games UNION ALL SELECT gameid, date, 1, red_team FROM games),
counted AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, gameid) - 1 AS prior FROM sides),
wide AS (SELECT gameid, max(prior) FILTER (s = 0) AS blue_prior, max(prior) FILTER (s = 1) AS red_prior FROM counted GROUP BY gameid)"""


def temporal_split(spark, d):
    s = T.split_by_position(M.stream(spark, d).select("gameid", "date", "target"), ["date", "gameid"], 0.8)
    return s.groupBy("is_train").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.avg(F.col("target").cast("double")), 6).alias("base_rate"))


SPLIT_SQL = M.sql(
    "SELECT seq <= floor(n * 0.8) AS is_train, count(*) AS n, min(date) AS first, max(date) AS last, round(avg(target), 6) AS base_rate FROM (SELECT *, row_number() OVER (ORDER BY date, gameid) AS seq, count(*) OVER () AS n FROM games) GROUP BY 1"
)


def recent_form(spark, d):
    f = T.recent_form(M.players(spark, d), ["player"], ["date", "gameid", "side", "position"], 10, ["quantity", "revenue"])
    return f.select("player", F.round("form_quantity", 6).alias("form_quantity"), rounded("form_revenue", 4).alias("form_revenue"), "games")


FORM_SQL = M.sql(
    "SELECT player, round(avg(quantity) FILTER (rn <= 10), 6) AS form_quantity, round(avg(revenue) FILTER (rn <= 10) + 1e-7, 4) AS form_revenue, count(*) AS games FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY date DESC, gameid DESC, side DESC, position DESC) AS rn FROM players) GROUP BY player"
)


def features(spark, d, p=None):
    """Two-sided rows with differences of trailing means, least continuity and flags."""
    t = T.trailing_mean(M.teams(M.players(spark, d) if p is None else p), ["revenue", "avg_quantity"], ["team"], ["date", "gameid", "side"], 10, 5)
    t = T.overlap_with_previous(t, F.col("lineup"), ["team"], ["date", "gameid", "side"], "continuity")
    g = P.differences(P.paired(t, "gameid", "side", "Blue", "Red", ["team", "date", "league", "revenue", "roll_revenue", "roll_avg_quantity", "continuity"]), ["roll_revenue", "roll_avg_quantity"])
    g = g.withColumn("min_continuity", F.least("blue_continuity", "red_continuity")).filter("blue_team <> red_team")
    return g.withColumn("target", (F.col("blue_revenue") >= F.col("red_revenue")).cast("int"))


_FEATURE_CTES = (
    CONTINUITY,
    "rolled AS (SELECT *, CASE WHEN count(revenue) OVER f >= 5 THEN avg(revenue) OVER f END AS rr, CASE WHEN count(avg_quantity) OVER f >= 5 THEN avg(avg_quantity) OVER f END AS rq FROM teams WINDOW f AS (PARTITION BY team ORDER BY date, gameid, side ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))",
    """feats AS (SELECT b.gameid, b.date, b.rr - r.rr AS diff_roll_revenue, b.rq - r.rq AS diff_roll_avg_quantity, least(cb.continuity, cr.continuity) AS min_continuity,
 CASE WHEN b.revenue >= r.revenue THEN 1 ELSE 0 END AS target FROM rolled b JOIN rolled r ON b.gameid = r.gameid AND b.side = 'Blue' AND r.side = 'Red' AND b.team <> r.team
 JOIN cont cb ON cb.gameid = b.gameid AND cb.side = 'Blue' JOIN cont cr ON cr.gameid = r.gameid AND cr.side = 'Red')""",
)


def master_features(spark, d):
    return features(spark, d).select("gameid", rounded("diff_roll_revenue", 4).alias("diff_roll_revenue"), F.round("diff_roll_avg_quantity", 6).alias("diff_roll_avg_quantity"), "min_continuity", "target")


def continuity_bands(spark, d):
    band = F.when(F.col("min_continuity") <= 0, "0").when(F.col("min_continuity") == 1, "1").when(F.col("min_continuity") >= 2, "2+").otherwise("first")
    return features(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("target").cast("double")), 6).alias("blue_rate"))


def impute_median(spark, d):
    """Median (mean of the middle two) in place of nulls, per feature."""
    f = features(spark, d).select("gameid", "diff_roll_revenue", "min_continuity")
    med = f.agg(F.median("diff_roll_revenue").alias("mr"), F.median("min_continuity").alias("mc"))
    return f.crossJoin(F.broadcast(med)).select("gameid", rounded(F.coalesce("diff_roll_revenue", "mr"), 4).alias("x"), F.coalesce("min_continuity", "mc").cast("double").alias("c"))


def standard_scale(spark, d):
    f = features(spark, d).select("gameid", F.col("diff_roll_avg_quantity").alias("x"))
    m = f.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return f.crossJoin(F.broadcast(m)).select("gameid", F.round((F.col("x") - F.col("m")) / F.col("s"), 6).alias("z"))


def average_rank(spark, d):
    e = _events(spark, d).withColumn("score", F.round("value", 1))
    return T.average_rank(e, "score", ["event_type"]).select("event_id", "event_type", "rank")


QUERIES = {
    "scan_clean_rows": (scan_clean_rows, SCAN_SQL),
    "null_policies": (null_dropping_range, NULL_SQL),
    "union_years": (union_years, UNION_SQL), "csv_years": (csv_years, CSV_SQL), "partitioned_years": (partitioned_years, YEARS_SQL),
    "policy_filter_coverage": (policy_filter_coverage, POLICY_SQL),
    "two_sided_games": (two_sided_games, M.sql("SELECT gameid, count(*) AS rows FROM players GROUP BY gameid HAVING count(DISTINCT side) = 2")),
    "full_lineups": (full_lineups, M.sql("SELECT gameid, side, position, player FROM players SEMI JOIN (SELECT gameid, side FROM teams WHERE n_roles = 3) f USING (gameid, side)")),
    "derived_ratio_kda": (derived_ratio_kda, KDA_SQL),
    "region_lookup_default": (region_lookup_default, LOOKUP_SQL),
    "cross_region_flag": (cross_region_flag, M.sql("SELECT cross_region, count(*) AS n, sum(target)::BIGINT AS blue_wins FROM games GROUP BY 1")),
    "bucket_case": (bucket_case, M.sql(f"SELECT {BUCKET} AS bucket, count(*) AS n FROM games GROUP BY 1")),
    "unmapped_labels": (unmapped_labels, M.sql("SELECT DISTINCT label FROM (SELECT blue_league AS label FROM games UNION ALL SELECT red_league FROM games) WHERE label NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')")),
    "team_frame_means": (team_frame_means, M.sql("SELECT gameid, side, team, round(avg_quantity, 6) AS mean_quantity, round(avg_price, 6) AS mean_price, round(avg_discount, 6) AS mean_discount, round(avg_tax, 6) AS mean_tax FROM teams")),
    "modal_home_region": (modal_home_region, M.sql("SELECT team, home FROM homes")),
    "pivot_lineups": (pivot_lineups, M.sql("SELECT gameid, side, " + ", ".join(f"max(player) FILTER (position = '{r}') AS \"{r}_player\"" for r in M.ROLES) + " FROM players GROUP BY gameid, side")),
    "pivot_role_stats": (pivot_role_stats, M.sql(f"SELECT gameid, side, {_PIVOT} FROM w GROUP BY gameid, side", _PLAYER_SQL.strip())),
    "role_differences": (role_differences, M.sql(
        "SELECT b.gameid, " + ", ".join(f'round(b."{c}" - r."{c}", 6) AS "diff_{c}"' if "roll" in c else f'b."{c}" - r."{c}" AS "diff_{c}"' for c in _ROLE_STATS) + " FROM pivoted b JOIN pivoted r ON b.gameid = r.gameid AND b.side = 'Blue' AND r.side = 'Red'",
        _PLAYER_SQL.strip(),
        "pivoted AS (SELECT gameid, side, " + ", ".join(f"max({c[2:]}) FILTER (position = '{c[0]}') AS \"{c}\"" for c in _ROLE_STATS) + " FROM w GROUP BY gameid, side)",
    )),
    "trailing_mean_player": (trailing_mean_player, M.sql("SELECT gameid, side, position, player, round(roll_quantity, 6) AS roll_quantity, round(roll_price, 6) AS roll_price, career FROM w", _PLAYER_SQL.strip())),
    "trailing_mean_team": (trailing_mean_team, TEAM_SQL),
    "trailing_mean_events": (trailing_mean_events, EVENT_ROLL_SQL),
    "pair_blue_red": (pair_blue_red, M.sql("SELECT b.gameid, b.team AS blue_team, r.team AS red_team, round(b.revenue - r.revenue, 4) AS diff_revenue, b.n_roles - r.n_roles AS diff_n_roles FROM teams b JOIN teams r ON b.gameid = r.gameid AND b.side = 'Blue' AND r.side = 'Red'")),
    "game_stream_home": (game_stream_home, M.sql("SELECT b.gameid, b.team AS blue_team, r.team AS red_team, b.home AS blue_home, r.home AS red_home FROM modes b JOIN modes r ON b.gameid = r.gameid AND b.side = 'Blue' AND r.side = 'Red'", *_TEAM_MODE)),
    "trailing_mode_home": (trailing_mode_home, M.sql("SELECT gameid, side, team, home FROM modes", *_TEAM_MODE)),
    "trailing_mode_events": (trailing_mode_events, "WITH " + ", ".join(_mode_sql("events", "user_id", "event_type", "ts, event_id", "event_id", 20)) + " SELECT event_id, user_id, home FROM modes"),
    "lookup_by_id": (lookup_by_id, M.sql("SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN coalesce(cross_region, false) THEN 1 ELSE 0 END)::BIGINT AS \"cross\" FROM orders LEFT JOIN games ON gameid = o_orderkey GROUP BY 1")),
    "shared_games": (shared_games, M.sql("SELECT (SELECT count(*) FROM (SELECT gameid FROM teams WHERE side = 'Blue' INTERSECT SELECT gameid FROM teams WHERE side = 'Red' AND n_roles >= 2)) AS shared, (SELECT count(*) FROM (SELECT gameid FROM teams WHERE side = 'Blue' EXCEPT ALL SELECT gameid FROM teams WHERE side = 'Red' AND n_roles >= 2)) AS only_first")),
    "semi_by_ids": (semi_by_ids, M.sql("SELECT league, count(*) AS n FROM players WHERE gameid IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= '1998-01-01') GROUP BY 1")),
    "latest_roster": (latest_roster, _roster_sql()),
    "latest_roster_asof": (latest_roster_asof, _roster_sql("WHERE p.date < '1997-07-01'")),
    "roster_as_of_games": (roster_as_of_games, AS_OF_SQL),
    "roster_continuity": (roster_continuity, M.sql("SELECT * FROM cont", CONTINUITY)),
    "prior_games_coverage": (prior_games_coverage, M.sql("SELECT count(*) AS games, round(avg(CASE WHEN blue_prior >= 10 AND red_prior >= 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage FROM wide", PRIOR.strip())),
    "temporal_split": (temporal_split, SPLIT_SQL),
    "recent_form": (recent_form, FORM_SQL),
    "master_features": (master_features, M.sql("SELECT gameid, round(diff_roll_revenue + 1e-7, 4) AS diff_roll_revenue, round(diff_roll_avg_quantity, 6) AS diff_roll_avg_quantity, min_continuity, target FROM feats", *_FEATURE_CTES)),
    "continuity_bands": (continuity_bands, M.sql("SELECT CASE WHEN min_continuity <= 0 THEN '0' WHEN min_continuity = 1 THEN '1' WHEN min_continuity >= 2 THEN '2+' ELSE 'first' END AS band, count(*) AS n, round(avg(target), 6) AS blue_rate FROM feats GROUP BY 1", *_FEATURE_CTES)),
    "impute_median": (impute_median, M.sql("SELECT gameid, round(coalesce(diff_roll_revenue, (SELECT median(diff_roll_revenue) FROM feats)) + 1e-7, 4) AS x, coalesce(min_continuity::DOUBLE, (SELECT median(min_continuity) FROM feats))::DOUBLE AS c FROM feats", *_FEATURE_CTES)),
    "standard_scale": (standard_scale, M.sql("SELECT gameid, round((diff_roll_avg_quantity - (SELECT avg(diff_roll_avg_quantity) FROM feats)) / (SELECT stddev_pop(diff_roll_avg_quantity) FROM feats), 6) AS z FROM feats", *_FEATURE_CTES)),
    "average_rank": (average_rank, "SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY round(value, 1)) + (count(*) OVER (PARTITION BY event_type, round(value, 1)) - 1) / 2.0 AS rank FROM events"),
}
