"""Queries on ratings, metrics, reports, serving and models, with their SQL."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import boosting, learn, metrics, serving
from ..operators import ratings as R
from ..operators import temporal as T
from ..operators.snapshots import RatingStore
from ..sources.tables import as_json, drop, folder, shared, written
from ..streaming.replay import replay_stream
from . import features as Q
from . import matchmodel as M

TEAM, PLAYER = R.Ladder(), R.Ladder(k=24.0, home=20.0, lineup=True)
PLAYER_RA = R.Ladder(k=24.0, home=20.0, beta=1.0, k_region=8.0, lineup=True)
REGION = R.Ladder(k=40.0, home=20.0, beta=1.0, k_region=8.0)
#: The points that are searched, in this order.
GRID = [R.Ladder(k=float(k), home=float(h)) for k in (12, 16, 20, 24, 28, 32, 40, 48, 64) for h in (0, 10, 20, 30, 40)]
REGION_GRID = [R.Ladder(k=40.0, home=20.0, beta=b, k_region=float(k)) for b in (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5) for k in (8, 16, 24, 32, 48)]
#: Region parameters are chosen on games before this day.
TUNED_BEFORE = "2000-01-01"
REPLICATES, LEAST_GROUP = 2000, 30
#: Seeds of the intervals of accuracy and log-loss, of models and of their differences.
SEEDS = {"accuracy": 42, "log_loss": 43, "accuracy_difference": 44, "log_loss_difference": 45}


def fold_sql(ladder: R.Ladder | SimpleNamespace, by_player: bool = False, name: str = "elo", points: str = "") -> str:
    """The replay as a recursive query that carries a map of ratings per pool.

    With ``points``, a table of parameters, each pool is replayed for each of its rows.
    """
    blue, red = ("list_transform(blue_lineup, lambda x: x::VARCHAR)", "list_transform(red_lineup, lambda x: x::VARCHAR)") if by_player else ("[blue_team]", "[red_team]")
    anchored = ladder.k_region is not None
    term = f"+ {ladder.beta} * (coalesce(g[{{0}}], {ladder.base}) - {ladder.base})" if anchored else ""
    mean = "list_avg(list_transform({0}, lambda x: coalesce(m[x], " + str(ladder.base) + ")))"
    moves = "NOT cross_region" if anchored else "true"
    sign = "(CASE WHEN list_contains({0}, x) THEN 1.0 ELSE 0.0 END - CASE WHEN list_contains({1}, x) THEN 1.0 ELSE 0.0 END)"
    return f"""
{name}_seq AS (SELECT {"pool || '#' || point AS pool, k, home, beta, k_region" if points else "pool"}, gameid, {blue} AS blue, {red} AS red, blue_region, red_region, cross_region, target, row_number() OVER (PARTITION BY {"point, " * bool(points)}pool ORDER BY date, gameid) AS i FROM games{", " * bool(points)}{points}),
{name}(pool, i, gameid, p, diff, target, m, g) AS (
  SELECT pool, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::INTEGER, MAP([]::VARCHAR[], []::DOUBLE[]), MAP([]::VARCHAR[], []::DOUBLE[]) FROM (SELECT DISTINCT pool FROM {name}_seq)
  UNION ALL
  SELECT pool, i, gameid, p, gap, target,
    CASE WHEN {moves} THEN map_concat(m, MAP(ks, list_transform(ks, lambda x: coalesce(m[x], {ladder.base}) + {ladder.k} * (target - p) * {sign.format('blue', 'red')}))) ELSE m END,
    CASE WHEN {moves} THEN g ELSE map_concat(g, MAP(rs, list_transform(rs, lambda x: coalesce(g[x], {ladder.base}) + {ladder.k_region or 0.0} * (target - p) * {sign.format('[blue_region]', '[red_region]')}))) END
  FROM (SELECT *, 1 / (1 + pow(10.0, -(gap + {ladder.home}) / 400)) AS p, list_distinct(list_concat(blue, red)) AS ks, list_distinct([blue_region, red_region]) AS rs
    FROM (SELECT s.*, e.m, e.g, ({mean.format('blue')} {term.format('blue_region')}) - ({mean.format('red')} {term.format('red_region')}) AS gap FROM {name} e JOIN {name}_seq s ON s.pool = e.pool AND s.i = e.i + 1)))"""


RATED_SQL = "SELECT pool, gameid, round(p, 6) AS p, round(diff, 4) AS diff, target FROM elo WHERE i > 0"


def _games(spark, d, by_player=False):
    return M.written_games(spark, d, lambda g: M.ladder_games(g, by_player), lineups=by_player)


def _rated(ladder, by_player=False):
    def query(spark, d):
        return R.replay(_games(spark, d, by_player), ladder, by_component=True).select("pool", "gameid", F.round("p", 6).alias("p"), F.round("diff", 4).alias("diff"), "target")

    return query, M.sql(RATED_SQL, fold_sql(ladder, by_player).strip(), recursive=True)


def elo_diff(spark, d):
    """The rating difference as a feature includes the home bonus."""
    return R.replay(_games(spark, d), TEAM).select("gameid", F.round(F.col("diff") + TEAM.home, 4).alias("elo_diff"))


def elo_stream(spark, d):
    return replay_stream(_games(spark, d), TEAM, f"{shared(spark)}/elo-{uuid.uuid4().hex}").select("pool", "gameid", F.round("p", 6).alias("p"), F.round("diff", 4).alias("diff"), "target")


#: Games of a slice in the queries on stored ratings.
STORED_SLICE = 5_000
#: The first stored games are those before this day, but for the last event's, which come in late.
STORED_BEFORE = "2000-01-01"


@M.over_history
def elo_incremental(spark, d):
    """Ratings of all games after three deliveries: most old games, new ones, and late old ones."""
    g = written(_games(spark, d).join(M.table(spark, d, "orders").select(F.col("o_orderkey").alias("gameid"), F.col("o_orderpriority").alias("event")), "gameid"), "games")
    old, late = F.col("date") < STORED_BEFORE, F.col("event") == "5-LOW"
    store = RatingStore(spark, folder(spark, "store"), TEAM, STORED_SLICE)
    for part in (old & ~late, ~old, old & late):
        store.advance(g.filter(part))
    return store.rated().select("pool", "gameid", F.round("p", 6).alias("p"), F.round("diff", 4).alias("diff"), "target")


@M.over_history
def rating_snapshots(spark, d):
    """Every team's rating at the ends of slices, from the one that moved it to the next that does."""
    store = RatingStore(spark, folder(spark, "store"), TEAM, STORED_SLICE)
    store.advance(_games(spark, d))
    return store.intervals().select("name", F.round("rating", 4).alias("rating"), F.col("since.gameid").alias("since"), F.col("until.gameid").alias("until"))


SNAPSHOT_SQL = M.history_sql(M.sql(
    "SELECT name, round(m[name], 4) AS rating, gameid AS since, lead(gameid) OVER (PARTITION BY name ORDER BY slice) AS until FROM played JOIN ends USING (slice) JOIN elo USING (i)",
    fold_sql(TEAM).strip(),
    f"played AS (SELECT DISTINCT (i - 1) // {STORED_SLICE} AS slice, unnest(list_concat(blue, red)) AS name FROM elo_seq)",
    f"ends AS (SELECT (i - 1) // {STORED_SLICE} AS slice, max(i) AS i FROM elo_seq GROUP BY 1)",
    recursive=True,
))


def _final(name: str, ladder: R.Ladder) -> str:
    last = "last AS (SELECT pool, m, g, row_number() OVER (PARTITION BY pool ORDER BY i DESC) AS rn FROM elo)"
    kind = {"member": "m", "region": "g"}[name]
    return f"{last}, finals AS (SELECT pool, x.key AS name, x.value AS rating FROM (SELECT pool, unnest(map_entries({kind})) AS x FROM last WHERE rn = 1))"


COUNTS = "counts AS (SELECT pool, team AS name, count(*) AS games FROM (SELECT pool, blue_team AS team FROM games UNION ALL SELECT pool, red_team FROM games) GROUP BY 1, 2)"


def elo_leaderboard(spark, d):
    """Ten best per pool set: final rating of teams with 10 games or more in the pool."""
    g = M.written_games(spark, d, lineups=False)
    n = g.select("pool", F.explode(F.array("blue_team", "red_team")).alias("name")).groupBy("pool", "name").agg(F.count("*").alias("games"))
    final = R.final_ratings(M.ladder_games(g), TEAM).filter("kind = 'member'")
    return final.join(n, ["pool", "name"]).filter("games >= 10").select("pool", "name", F.round("rating", 4).alias("rating"), "games").orderBy(F.desc("rating"), "pool", "name").limit(10)


def region_rank(spark, d):
    f = R.final_ratings(_games(spark, d), REGION).filter("kind = 'region'")
    return f.groupBy("name").agg(F.round(F.avg("rating"), 4).alias("rating"), F.count("*").alias("pools"))


def _grid(ladders, cross, before=None):
    def query(spark, d):
        g = R.grid(_games(spark, d), ladders, score_before=before, cross_only=cross)
        return g.select("point", "k", "home", "beta", "k_region", "games", F.round("log_loss", 6).alias("log_loss"), "best")

    values = ", ".join(f"({i}, {x.k}::DOUBLE, {x.home}::DOUBLE, {x.beta}::DOUBLE, {-1.0 if x.k_region is None else x.k_region}::DOUBLE)" for i, x in enumerate(ladders))
    named = SimpleNamespace(k="k", home="home", beta="beta", base=R.Ladder.base, k_region="k_region" if cross else None)
    only = " AND games.cross_region" * cross + (f" AND games.date < TIMESTAMP '{before}'" if before else "")
    loss = "-avg(ln(greatest(least(CASE WHEN e.target = 1 THEN p ELSE 1 - p END, 1 - 1e-15), 1e-15)))"
    body = f"""SELECT point, k, home, beta, k_region, n AS games, round(loss, 6) AS log_loss, row_number() OVER (ORDER BY round(loss, 9), point) AS best
FROM (SELECT split_part(e.pool, '#', 2)::INTEGER AS point, count(*) AS n, {loss} AS loss FROM e JOIN games USING (gameid) WHERE i > 0{only} GROUP BY 1) JOIN points USING (point)"""
    points = f"points AS (SELECT * FROM (VALUES {values}) v(point, k, home, beta, k_region))"
    return query, M.sql(body, points, fold_sql(named, name="e", points="points").strip(), recursive=True)


def scored(spark, d, keep=lambda g: g):
    """Games with the team model's p, the player model's q and the report's columns.

    All games are rated; ``keep`` says which of them are reported. The stream is built and
    written once, and read by the report and by one replay of both models.
    """
    g = M.written_games(spark, d, Q.bucketed)
    rated = R.replay_all(M.rated_games(g), {"team": TEAM, "player": PLAYER})
    return keep(g).join(rated.select("gameid", F.col("team_p").alias("p"), F.col("player_p").alias("q")), "gameid")


SCORED = (
    fold_sql(TEAM).strip(), fold_sql(PLAYER, True, "pelo").strip(),
    f"scored AS (SELECT games.*, {Q.BUCKET} AS bucket, elo.p AS p, pelo.p AS q FROM games JOIN elo ON elo.gameid = games.gameid JOIN pelo ON pelo.gameid = games.gameid)",
)


def _sql(body, *more):
    return M.sql(body, *SCORED, *more, recursive=True)


_LOSS = "-(target * ln(greatest(least({0}, 1 - 1e-15), 1e-15)) + (1 - target) * ln(1 - greatest(least({0}, 1 - 1e-15), 1e-15)))"
_POINT = f"count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, round(avg({_LOSS.format('p')}), 6) AS log_loss, round(avg(pow(p - target, 2)), 6) AS brier, round(greatest(avg(target), 1 - avg(target)), 6) AS baseline"


def _rounded(df, *but):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def _points(df, *groups):
    return _rounded(df.groupBy(*groups).agg(*metrics.point_metrics(F.col("target"), F.col("p"))))


def point_metrics(spark, d):
    return _points(scored(spark, d))


def metrics_by_bucket(spark, d):
    """Overlapping slices: every game counts in its bucket and in ``overall``."""
    s = scored(spark, d).withColumn("slice", F.explode(F.array(F.lit("overall"), F.col("bucket"))))
    return _points(s, "slice")


def constant_baseline(spark, d):
    s = scored(spark, d)
    rate = s.agg(F.avg(F.col("target").cast("double")).alias("rate"))
    return _points(s.drop("p").crossJoin(F.broadcast(rate)).withColumnRenamed("rate", "p"))


def auc_by_group(spark, d):
    return _rounded(metrics.auc(scored(spark, d), "target", "p", ["bucket"]))


AUC_SQL = """SELECT bucket, CASE WHEN sum(target) > 0 AND sum(target) < count(*) THEN round((sum(rk) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * (count(*) - sum(target))), 6)::DOUBLE END AS auc
FROM (SELECT *, rank() OVER (PARTITION BY bucket ORDER BY p) + (count(*) OVER (PARTITION BY bucket, p) - 1) / 2.0 AS rk FROM scored) GROUP BY bucket"""


def class_report(spark, d):
    return _rounded(metrics.class_report(scored(spark, d), "target", "p"))


CLASS_SQL = """SELECT label, round(tp / said, 6)::DOUBLE AS precision, round(tp / held, 6)::DOUBLE AS recall, held AS support, round(2.0 * (tp / said) * (tp / held) / (tp / said + tp / held), 6)::DOUBLE AS f1
FROM (SELECT label, count(*) FILTER (target = label AND z = label) AS tp, count(*) FILTER (z = label) AS said, count(*) FILTER (target = label) AS held
  FROM (SELECT target, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS z FROM scored), (VALUES (0), (1)) l(label) GROUP BY label)"""


def calibration_bins(spark, d):
    return _rounded(metrics.calibration(scored(spark, d), "target", "p"))


CALIBRATION_SQL = "SELECT greatest(ceil(p * 10) - 1, 0)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(target), 6) AS mean_y FROM scored GROUP BY 1"


def mcnemar(spark, d):
    """Discordant counts of the two models per bucket and the exact p."""
    s = scored(spark, d).withColumns({c + "_hit": (F.col(c) >= 0.5) == (F.col("target") == 1) for c in ("p", "q")})
    n = s.groupBy("bucket").agg(F.count(F.when(F.col("p_hit") & ~F.col("q_hit"), 1)).alias("only_p"), F.count(F.when(~F.col("p_hit") & F.col("q_hit"), 1)).alias("only_q"))
    return _rounded(n.withColumn("p_value", metrics.mcnemar(F.col("only_p"), F.col("only_q"))))


MCNEMAR_SQL = """SELECT bucket, only_p, only_q, round(CASE WHEN only_p + only_q = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_p, only_q) + 1), lambda i:
  exp(lgamma(only_p + only_q + 1) - lgamma(i + 1) - lgamma(only_p + only_q - i + 1) - (only_p + only_q) * ln(2.0))))) END, 6) AS p_value
FROM (SELECT bucket, count(*) FILTER ((p >= 0.5) = (target = 1) AND (q >= 0.5) <> (target = 1)) AS only_p, count(*) FILTER ((p >= 0.5) <> (target = 1) AND (q >= 0.5) = (target = 1)) AS only_q FROM scored GROUP BY bucket)"""


def _hit(p):
    return ((F.col(p) >= 0.5) == (F.col("target") == 1)).cast("double")


def _boot(measures):
    """Intervals per bucket; ``measures``: seed name -> {measure: column}, drawn together."""

    def query(spark, d):
        columns = {m: c for group in measures.values() for m, c in group.items()}
        s = written(scored(spark, d).select("bucket", "gameid", *[c.alias(m) for m, c in columns.items()]), "scored")
        out = None
        for name, group in measures.items():
            b = metrics.bootstrap(s, list(group), "gameid", REPLICATES, SEEDS[name], ["bucket"], LEAST_GROUP)
            out = b if out is None else out.union(b)
        means = s.groupBy("bucket").agg(*[F.avg(m).alias(m) for m in columns]).unpivot("bucket", list(columns), "measure", "mean")
        joined = means.join(out, ["bucket", "measure"]).withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))
        return _rounded(joined.select("bucket", "measure", "mean", "lo", "hi", "replicates", "significant"))

    return query


def _boot_sql(measures):
    """The same by one row per game, hash and draw."""
    draws, steps = metrics.DRAWS, metrics.poisson_steps()
    times = "CASE " + " ".join(f"WHEN digits < '{x}' THEN {n}" for n, x in enumerate(steps)) + f" ELSE {len(steps)} END"
    parts = []
    for name, group in measures.items():
        h = f"(SELECT *, md5('{SEEDS[name]}|' || r || '|' || gameid) AS h FROM sized, range({-(-REPLICATES // draws)}) t(r) WHERE n >= {LEAST_GROUP})"
        w = f"(SELECT *, {times} AS w FROM (SELECT *, r * {draws} + k AS rep, substring(h, 8 * k + 1, 8) AS digits FROM {h}, range({draws}) u(k)))"
        sums = f"(SELECT bucket, rep, " + ", ".join(f"sum(w * {m}) / nullif(sum(w), 0) AS {m}" for m in group) + f" FROM {w} WHERE rep < {REPLICATES} GROUP BY ALL)"
        parts += [f"SELECT bucket, '{m}' AS measure, quantile_cont({m}, 0.025) AS lo, quantile_cont({m}, 0.975) AS hi, count(*) AS replicates FROM {sums} GROUP BY bucket" for m in group]
    names = [m for group in measures.values() for m in group]
    means = " UNION ALL ".join(f"SELECT bucket, '{m}' AS measure, avg({m}) AS mean FROM sized GROUP BY bucket" for m in names)
    exprs = ", ".join(f"{_BOOT_SQL[m]} AS {m}" for m in names)
    return _sql(
        "SELECT bucket, measure, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, replicates, lo > 0 OR hi < 0 AS significant FROM boots JOIN means USING (bucket, measure)",
        f"sized AS (SELECT bucket, gameid, {exprs}, count(*) OVER (PARTITION BY bucket) AS n FROM scored)", f"boots AS ({' UNION ALL '.join(parts)})", f"means AS ({means})",
    )


def _single():
    return {
        "accuracy": {"team_accuracy": _hit("p"), "player_accuracy": _hit("q")},
        "log_loss": {"team_log_loss": X.log_loss(F.col("target"), F.col("p")), "player_log_loss": X.log_loss(F.col("target"), F.col("q"))},
    }


def _paired():
    return {
        "accuracy_difference": {"accuracy": _hit("p") - _hit("q")},
        "log_loss_difference": {"log_loss": X.log_loss(F.col("target"), F.col("p")) - X.log_loss(F.col("target"), F.col("q"))},
    }


_HIT_SQL = "(CASE WHEN ({0} >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END)::DOUBLE"
_BOOT_SQL = {
    "team_accuracy": _HIT_SQL.format("p"), "player_accuracy": _HIT_SQL.format("q"), "team_log_loss": _LOSS.format("p"), "player_log_loss": _LOSS.format("q"),
    "accuracy": f"{_HIT_SQL.format('p')} - {_HIT_SQL.format('q')}", "log_loss": f"({_LOSS.format('p')}) - ({_LOSS.format('q')})",
}


def cumulative_accuracy(spark, d):
    """Running accuracy and loss after each game of the global order."""
    s = scored(spark, d)
    hit = ((F.col("p") >= 0.5) == (F.col("target") == 1)).cast("double")
    out = T.running(s, ["date", "gameid"], {"i": F.lit(1.0), "hits": hit, "losses": X.log_loss(F.col("target"), F.col("p"))})
    return out.select("gameid", F.col("i").cast("long").alias("i"), F.round(F.col("hits") / F.col("i"), 6).alias("cum_acc"), F.round(F.col("losses") / F.col("i"), 6).alias("cum_log_loss"))


CUMULATIVE_SQL = f"SELECT gameid, row_number() OVER w AS i, round(avg(CASE WHEN (p >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END) OVER w, 6)::DOUBLE AS cum_acc, round(avg({_LOSS.format('p')}) OVER w, 6) AS cum_log_loss FROM scored WINDOW w AS (ORDER BY date, gameid ROWS UNBOUNDED PRECEDING)"


def _season(spark, d):
    """Scored games of the last season between teams of major regions."""

    def keep(g):
        last = g.agg(F.max(F.year("date")).alias("_y"))
        return g.crossJoin(F.broadcast(last)).filter((F.year("date") == F.col("_y")) & X.is_major(F.col("blue_league"), M.MAJOR) & X.is_major(F.col("red_league"), M.MAJOR)).drop("_y")

    return scored(spark, d, keep)


SEASON = "season AS (SELECT * FROM scored WHERE year(date) = (SELECT max(year(date)) FROM scored) AND blue_league IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE') AND red_league IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE'))"


def season_summary(spark, d):
    return _points(_season(spark, d))


def season_by_league(spark, d):
    return _points(_season(spark, d), "blue_league").filter("n >= 10")


def season_timeline(spark, d):
    s = _season(spark, d)
    hit = ((F.col("p") >= 0.5) == (F.col("target") == 1)).cast("double")
    out = T.running(s, ["date", "gameid"], {"i": F.lit(1.0), "hits": hit})
    return out.select(F.col("i").cast("long").alias("i"), F.date_format("date", "yyyy-MM-dd").alias("day"), F.round(F.col("hits") / F.col("i"), 6).alias("cum_acc"))


def recent_games_log(spark, d):
    """The newest 150 games of the season."""
    s = _season(spark, d).orderBy(F.desc("date"), F.desc("gameid")).limit(150)
    return s.select("gameid", F.date_format("date", "yyyy-MM-dd").alias("day"), "blue_team", "red_team", F.round("p", 4).alias("p"), F.when(F.col("p") >= 0.5, F.col("blue_team")).otherwise(F.col("red_team")).alias("predicted"), ((F.col("p") >= 0.5) == (F.col("target") == 1)).alias("correct"))


LOG_SQL = "SELECT gameid, strftime(date, '%Y-%m-%d') AS day, blue_team, red_team, round(p, 4) AS p, CASE WHEN p >= 0.5 THEN blue_team ELSE red_team END AS predicted, (p >= 0.5) = (target = 1) AS correct FROM season ORDER BY date DESC, gameid DESC LIMIT 150"


def teams_by_region(spark, d):
    h = Q.modal_home_region(spark, d)
    return h.groupBy("home").agg(F.array_join(F.array_sort(F.collect_set("team")), ",").alias("teams"))


def team_counts(spark, d):
    g = M.stream(spark, d)
    return g.select(F.explode(F.array("blue_team", "red_team")).alias("team")).groupBy("team").agg(F.count("*").alias("games"))


ASKED = ("Brand#11", " brand#12 ", "Brandd#13", "Brand#99", "Manufacturer#1", "REGION")


def name_resolve(spark, d):
    """Catalogue: teams whose home is a major region; the others are known but unsupported."""
    h = Q.modal_home_region(spark, d).withColumnRenamed("team", "name")
    return serving.resolve(spark.createDataFrame([(a,) for a in ASKED], "name string"), h.filter(F.col("home") != "ASIA"), h)


RESOLVE_SQL = M.sql(
    """SELECT asked, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN any_case IS NOT NULL THEN 'case' WHEN outside IS NOT NULL THEN 'unsupported' WHEN nearest IS NOT NULL THEN 'suggested' ELSE 'unknown' END AS how,
  coalesce(exact, any_case, CASE WHEN outside IS NULL THEN nearest END) AS resolved
FROM (SELECT asked, (SELECT max(team) FROM catalog WHERE team = asked) AS exact, (SELECT min(team) FROM catalog WHERE lower(team) = lower(asked)) AS any_case, (SELECT min(team) FROM homes WHERE lower(team) = lower(asked)) AS outside,
  (SELECT min_by(team, (levenshtein(lower(team), lower(asked)), team)) FROM catalog WHERE levenshtein(lower(team), lower(asked)) <= 5) AS nearest FROM asked)""",
    "catalog AS (SELECT * FROM homes WHERE home <> 'ASIA')",
    "asked AS (SELECT trim(a) AS asked FROM (VALUES " + ", ".join(f"('{a}')" for a in ASKED) + ") v(a))",
)


def matchup_features(spark, d):
    """Serve-time rows: latest roster of every team with form of the last ten rows and ratings.

    Ratings are those after the last pool; players unseen in it have the base. That is what the
    SQL asks for; ``matchup_features_history`` has the ratings after all games.
    """
    serving.check_request("Brand#11", "Brand#12", 10)
    form = Q.recent_form(spark, d)
    g = _games(spark, d, True)
    last = g.agg(F.max("pool").alias("pool"))
    final = R.final_ratings(g.join(F.broadcast(last), "pool", "left_semi"), PLAYER).filter("kind = 'member'").select(F.col("name").cast("long").alias("name"), "rating")
    rows = serving.with_default(Q.latest_roster(spark, d).join(form, "player", "left"), final, "player")
    return rows.select("team", "position", "player", "form_quantity", "games", F.round("rating", 4).alias("rating"))


MATCHUP_SQL = M.sql(
    "SELECT r.team, r.position, r.player, form_quantity, games, round(coalesce(rating, 1500.0), 4) AS rating FROM roster r LEFT JOIN form USING (player) LEFT JOIN finals ON finals.name = r.player::VARCHAR AND finals.pool = (SELECT max(pool) FROM games)",
    fold_sql(PLAYER, True).strip(), _final("member", PLAYER),
    "roster AS (SELECT team, position, player FROM (SELECT t.team, p.position, p.player, row_number() OVER (PARTITION BY t.team, p.position ORDER BY p.date DESC, p.gameid DESC, p.side DESC) AS rn FROM players p JOIN teams t USING (gameid, side)) WHERE rn = 1)",
    "form AS (SELECT player, round(avg(quantity) FILTER (rn <= 10), 6) AS form_quantity, count(*) AS games FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY date DESC, gameid DESC, side DESC, position DESC) AS rn FROM players) GROUP BY player)",
    recursive=True,
)

STATS = ["diff_roll_revenue", "diff_roll_avg_quantity", "min_continuity", *[f"diff_{r}_{c}" for r in M.ROLES for c in ("roll_quantity", "roll_price", "career")]]
RATINGS = ["elo", "pelo", "relo", "pelo_ra"]
FEATURES = [*STATS, "pelo", "relo"]
#: The ablation: stats alone, with player ratings, with region ratings, with anchored player ratings, with all.
SETS = {"stats": STATS, "full": [*STATS, "pelo"], "combined": FEATURES, "anchored": [*STATS, "pelo_ra", "relo"], "both": [*STATS, "pelo", "pelo_ra", "relo"]}
LADDERS = {"elo": TEAM, "pelo": PLAYER, "relo": REGION, "pelo_ra": PLAYER_RA}
ROUNDS = 50


def model_frame(spark, d):
    """Written rows of (gameid, date, stats, ratings, target), one per game; stats of unknown form are null."""
    p = written(M.players(spark, d).drop("discount", "tax"), "players")  # the base of games and of both kinds of windows
    p_all = p.withColumns({c: F.lit(None).cast("double") for c in ("discount", "tax")})
    g = M.written_games(spark, d, M.rated_games, p_all)
    f = Q.features(spark, d, p_all).join(Q.role_differences(spark, d, p_all), "gameid", "left").select("gameid", F.col("blue_date").alias("date"), *STATS, "target")
    rated = R.replay_all(g, LADDERS)
    out = written(f.join(rated.select("gameid", *[F.col(f"{name}_diff").alias(name) for name in LADDERS]), "gameid"), "model-frame")
    drop(p, g)
    return out


def _holdout(spark, d):
    """The first 80 percent of the games and the rest. Fitting is a driver action by nature: it
    runs while the query is built and reads the written frame."""
    frame = model_frame(spark, d)
    s = written(T.split_by_position(frame, ["date", "gameid"], 0.8).drop("seq"), "holdout")
    drop(frame)
    return s.filter("is_train").drop("is_train"), s.filter("not is_train").drop("is_train")


def logreg_holdout(spark, d):
    """Ablation: each set of features fitted on the first 80 percent and scored on the rest."""
    train, test = _holdout(spark, d)
    n, out = train.count(), None
    for name, columns in SETS.items():
        row = _points(learn.fit(train, columns, learn.logistic(n)).score(test)).select(F.lit(name).alias("features"), "*")
        out = row if out is None else out.union(row)
    return out


def gbt_holdout(spark, d):
    train, test = _holdout(spark, d)
    return _points(learn.fit(train, FEATURES, learn.boosted(ROUNDS)).score(test))


def boosted_holdout(spark, d):
    """The holdout scored by 400 rounds of second-order trees, beside the library's trees."""
    train, test = _holdout(spark, d)
    plans = {"second order": boosting.Boosting(key="gameid"), "library": learn.boosted(ROUNDS)}
    parts = []
    for name, plan in plans.items():
        scored = learn.fit(train, FEATURES, plan).score(test).withColumn("model", F.lit(name))
        point, auc = _points(scored).select(F.lit(name).alias("model"), "*"), _rounded(metrics.auc(scored, "target", "p", ["model"]))
        parts.append(point.join(auc, "model"))
    return parts[0].unionByName(parts[1])


def feature_importance(spark, d):
    train, _ = _holdout(spark, d)
    return spark.createDataFrame(learn.fit(train, FEATURES, learn.boosted(ROUNDS)).weights(), "feature string, importance double")


def walk_forward(spark, d):
    """Train on everything before the last season, score the season."""
    f = model_frame(spark, d)
    start = f.agg(F.max(F.year("date"))).first()[0]
    train = f.filter(F.year("date") < start)
    return _points(learn.fit(train, FEATURES, learn.logistic(train.count())).score(f.filter(F.year("date") == start)))


def split_counts(spark, d):
    """Sizes and base rates of the holdout's two parts, which its fits rest on."""
    train, test = _holdout(spark, d)
    both = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(F.col("target").cast("double")), 6).alias("base_rate"), F.count("diff_A_roll_quantity").alias("with_form"))


SPLIT_COUNTS_SQL = M.sql(
    "SELECT CASE WHEN seq <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(target), 6) AS base_rate, count(f) AS with_form FROM (SELECT games.*, b.roll_quantity - r.roll_quantity AS f, row_number() OVER (ORDER BY games.date, games.gameid) AS seq, count(*) OVER () AS n"
    " FROM games LEFT JOIN w b ON b.gameid = games.gameid AND b.side = 'Blue' AND b.position = 'A' LEFT JOIN w r ON r.gameid = games.gameid AND r.side = 'Red' AND r.position = 'A') GROUP BY 1",
    Q._PLAYER_SQL.strip(),
)


def final_model(spark, d, frame=None):
    """Holdout figures, then the model refitted on all games, stored and loaded again."""
    f = model_frame(spark, d) if frame is None else frame
    s = written(T.split_by_position(f, ["date", "gameid"], 0.8), "holdout")
    train = s.filter("is_train")
    held = _points(learn.fit(train, FEATURES, learn.logistic(train.count())).score(s.filter("not is_train").drop("seq", "is_train")))
    n = f.count()
    fitted = learn.fit(f, FEATURES, learn.logistic(n))
    path = f"{shared(spark)}/model-{uuid.uuid4().hex}"
    learn.save(fitted, path)
    return held, learn.load(spark, path), n


def refit_model(spark, d):
    """Holdout figures beside those of the loaded refit on all games (seen in its training)."""
    frame = model_frame(spark, d)
    held, model, n = final_model(spark, d, frame)
    return held.select(F.lit("holdout").alias("model"), "*").union(_points(model.score(frame)).select(F.lit("refit").alias("model"), "*"))


MATCHUPS = (("Brand#11", "Brand#12"), ("Brand#23", "Brand#7"), ("brand#5", "Brand#11"))


@M.over_history
def matchup_rows(spark, d, pairs=MATCHUPS, changes=(), window: int = 10):
    """One row per asked matchup with the model's features, from the state after all games.

    Form and price are means of a player's last ``window`` rows, ratings those after the last game
    (unseen: the base), continuity is that of a full lineup. ``changes`` are (team, position,
    player) that replace the roster's; an unknown player has no form and 0 games. Names that are
    not served, equal names, a window out of bounds and incomplete rosters raise an error.
    """
    teams = Q.modal_home_region(spark, d).select(F.col("team").alias("name"))
    for blue, red in pairs:
        serving.check_request(blue, red, window)
    names = spark.createDataFrame([(n,) for p in pairs for n in p], "name string")
    found = {r.asked: r.resolved for r in serving.resolve(names, teams, teams).filter("how in ('exact', 'case')").collect()}  # at most the asked names
    if lost := sorted({n.strip() for p in pairs for n in p} - set(found)):
        raise serving.RequestError(f"not served: {', '.join(lost)}")
    sides = spark.createDataFrame([(i, side, found[n.strip()]) for i, p in enumerate(pairs) for side, n in zip(("blue", "red"), p, strict=True)], "match int, side string, team string")
    roster = Q.latest_roster(spark, d).select("team", "position", F.col("player").cast("string").alias("player"))
    if changes:
        roster = serving.override(roster, spark.createDataFrame(list(changes), "team string, position string, player string"))
    held = sides.select("team").distinct().join(roster, "team", "left")
    if lost := [r.team for r in serving.completeness(held, M.ROLES).filter("not complete").orderBy("team").collect()]:  # at most the asked teams
        raise serving.RequestError(f"incomplete rosters: {', '.join(lost)}")
    p = written(M.players(spark, d), "players")
    form = T.recent_form(p, ["player"], ["date", "gameid", "side", "position"], window, ["quantity", "price"]).withColumn("player", F.col("player").cast("string"))
    g = M.written_games(spark, d, M.rated_games, p)
    every = written(R.final_ratings_all(g, LADDERS), "ratings")
    ended = {name: every.filter(F.col("ladder") == name) for name in LADDERS}

    def rating(df, name, key, kind="member", into=None):
        return serving.with_default(df, ended[name].filter(F.col("kind") == kind), key, into=into or name)

    lineup = sides.join(roster, "team").join(form, "player", "left").withColumn("games", F.coalesce("games", F.lit(0)))
    lineup = rating(rating(lineup, "pelo", "player"), "pelo_ra", "player")
    roles = [F.max(F.when(F.col("position") == r, F.col(c))).alias(f"{r}_{n}") for r in M.ROLES for n, c in (("roll_quantity", "form_quantity"), ("roll_price", "form_price"), ("career", "games"))]
    t = M.teams(p)
    last = T.recent_form(t, ["team"], ["date", "gameid", "side"], window, ["revenue", "avg_quantity"]).select("team", F.col("form_revenue").alias("roll_revenue"), F.col("form_avg_quantity").alias("roll_avg_quantity"))
    home = Q.modal_home_region(spark, d).withColumn("region", F.when(X.is_major(F.col("home"), M.MAJOR), F.col("home")).otherwise("OTHER")).select("team", "region")
    each = lineup.groupBy("match", "side", "team").agg(F.avg("pelo").alias("pelo"), F.avg("pelo_ra").alias("pelo_ra"), F.count("*").alias("n_roles"), *roles).join(last, "team").join(home, "team")
    each = rating(rating(rating(rating(each, "elo", "team"), "relo", "team"), "relo", "region", "region", "at_relo"), "pelo_ra", "region", "region", "at_pelo_ra")
    each = each.withColumns({"relo": F.col("relo") + REGION.beta * (F.col("at_relo") - REGION.base), "pelo_ra": F.col("pelo_ra") + PLAYER_RA.beta * (F.col("at_pelo_ra") - PLAYER_RA.base)})
    columns = ["roll_revenue", "roll_avg_quantity", *[f"{r}_{n}" for r in M.ROLES for n in ("roll_quantity", "roll_price", "career")]]
    both = each.filter("side = 'blue'").select("match", *[F.col(c).alias(f"b_{c}") for c in ("team", "n_roles", *columns, *RATINGS)]).join(each.filter("side = 'red'").select("match", *[F.col(c).alias(f"r_{c}") for c in ("team", "n_roles", *columns, *RATINGS)]), "match")
    diffs = [(F.col(f"b_{c}") - F.col(f"r_{c}")).alias(c if c in RATINGS else f"diff_{c}") for c in (*columns, *RATINGS)]
    return both.select("match", F.col("b_team").alias("blue"), F.col("r_team").alias("red"), F.lit(len(M.ROLES)).cast("long").alias("min_continuity"), *diffs)


@M.over_history
def predict_matchup(spark, d):
    """The stored model's answer to each asked matchup."""
    model = final_model(spark, d)[1]
    p = model.score(matchup_rows(spark, d))
    winner = F.when(F.col("p") >= 0.5, F.col("blue")).otherwise(F.col("red"))
    return p.select("match", "blue", "red", F.round("elo", 1).alias("elo_diff"), F.round("pelo", 1).alias("pelo_diff"), F.col("p").alias("p_blue"), (1 - F.col("p")).alias("p_red"), winner.alias("winner"), F.greatest("p", 1 - F.col("p")).alias("confidence"))


def prediction_json(spark, d):
    """The answer to each asked matchup as one nested JSON text."""
    side = lambda c: F.struct(F.col(c).alias("team"), F.col(f"p_{c}").alias("p"))
    p = predict_matchup(spark, d)
    return p.select("match", F.to_json(F.struct(side("blue").alias("blue"), side("red").alias("red"), F.struct("elo_diff", "pelo_diff").alias("ratings"), "winner", "confidence")).alias("json"))


def season_json(spark, d):
    """The season's report as nested JSON texts, a row per section and key: the summary, each league,
    and each day with its games in order, so that no text grows with the season."""
    s = written(_season(spark, d), "season")
    point = [F.round(c, 4).alias(c) for c in ("accuracy", "log_loss")]
    n = s.agg(*metrics.point_metrics(F.col("target"), F.col("p"))).select(F.lit("summary").alias("section"), F.lit("").alias("key"), F.to_json(F.struct("n", F.struct(*point).alias("model"))).alias("json"))
    leagues = s.groupBy("blue_league").agg(*metrics.point_metrics(F.col("target"), F.col("p"))).select(F.lit("league").alias("section"), F.col("blue_league").alias("key"), F.to_json(F.struct(F.col("blue_league").alias("league"), F.struct("n", *point).alias("model"))).alias("json"))
    game = F.struct("gameid", F.array("blue_team", "red_team").alias("teams"), F.round("p", 4).alias("p"), ((F.col("p") >= 0.5) == (F.col("target") == 1)).alias("correct"))
    days = s.groupBy(F.date_format("date", "yyyy-MM-dd").alias("key")).agg(F.array_sort(F.collect_list(game)).alias("games"))
    return n.union(leagues).union(days.select(F.lit("day").alias("section"), "key", F.to_json(F.struct(F.col("key").alias("day"), "games")).alias("json")))


_MODEL = f"round(avg(CASE WHEN (p >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS accuracy, round(avg({_LOSS.format('p')}), 4) AS log_loss"
SEASON_JSON_SQL = f"""SELECT 'summary' AS section, '' AS key, to_json({{'n': n, 'model': {{'accuracy': accuracy, 'log_loss': log_loss}}}})::VARCHAR AS json FROM (SELECT count(*) AS n, {_MODEL} FROM season)
UNION ALL SELECT 'league', blue_league, to_json({{'league': blue_league, 'model': {{'n': n, 'accuracy': accuracy, 'log_loss': log_loss}}}})::VARCHAR FROM (SELECT blue_league, count(*) AS n, {_MODEL} FROM season GROUP BY 1)
UNION ALL SELECT 'day', day, to_json({{'day': day, 'games': games}})::VARCHAR FROM (
  SELECT strftime(date, '%Y-%m-%d') AS day, list({{'gameid': gameid, 'teams': [blue_team, red_team], 'p': round(p, 4), 'correct': (p >= 0.5) = (target = 1)}} ORDER BY gameid) AS games FROM season GROUP BY 1)"""


def rosters_overridden(spark, d):
    """Latest rosters in which each team's players of an earlier day take their roles again: the
    wishes are texts ``team:role=player``, made of that day's rosters, parsed and applied."""
    old = Q.latest_roster_asof(spark, d)
    wishes = old.select(F.concat_ws("", "team", F.lit(": "), F.lower("position"), F.lit(" = "), F.col("player").cast("string")).alias("item"))
    changes = serving.parse_overrides(wishes, M.ROLES).filter("refused IS NULL")
    return serving.override(Q.latest_roster(spark, d).withColumn("player", F.col("player").cast("string")), changes)


def _old_rosters(where: str) -> str:
    return f"SELECT team, position, player::VARCHAR AS player FROM (SELECT t.team, p.position, p.player, row_number() OVER (PARTITION BY t.team, p.position ORDER BY p.date DESC, p.gameid DESC, p.side DESC) AS rn FROM players p JOIN teams t USING (gameid, side) {where}) WHERE rn = 1"


OVERRIDDEN_SQL = M.sql(
    "SELECT team, position, coalesce(o.player, n.player) AS player FROM latest n FULL JOIN earlier o USING (team, position)",
    f"latest AS ({_old_rosters('')})", f"earlier AS ({_old_rosters("WHERE p.date < '1997-07-01'")})",
)


def name_suggest(spark, d):
    """Up to five served teams whose names are like an asked one that is not served."""
    h = Q.modal_home_region(spark, d).withColumnRenamed("team", "name")
    return serving.suggest(spark.createDataFrame([(a,) for a in ASKED], "name string"), h.filter(F.col("home") != "ASIA"))


def roster_overrides(spark, d):
    """What texts ``team:role=player`` ask for, or why they are refused: each player of a latest roster
    is asked for twice, then in an unknown role and without any."""
    r = Q.latest_roster(spark, d)
    texts = (F.concat("team", F.lit(": "), "position", F.lit(" = "), "player"), F.concat("team", F.lit(":"), F.lower("position"), F.lit("="), "player", F.lit("=x:y ")), F.concat("team", F.lit(":top="), "player"), F.concat("team", F.lit(" no role "), "player"))
    return serving.parse_overrides(r.select(F.explode(F.array(*texts)).alias("item")), M.ROLES)


_ROLE_LIST = ", ".join(f"'{r}'" for r in M.ROLES)
OVERRIDE_SQL = M.sql(
    f"""SELECT item, CASE WHEN ok THEN team END AS team, CASE WHEN ok THEN role END AS position, CASE WHEN ok THEN player END AS player,
       CASE WHEN eq = 0 THEN 'no role=player' WHEN role NOT IN ({_ROLE_LIST}) THEN 'unknown role' END AS refused
FROM (SELECT *, eq > 0 AND role IN ({_ROLE_LIST}) AS ok FROM (
  SELECT item, strpos(rest, '=') AS eq, trim(team) AS team, upper(trim(substring(rest, 1, strpos(rest, '=') - 1))) AS role, trim(substring(rest, strpos(rest, '=') + 1)) AS player
  FROM (SELECT item, split_part(item, ':', 1) AS team, CASE WHEN strpos(item, ':') > 0 THEN substring(item, strpos(item, ':') + 1) ELSE item END AS rest FROM items)))""",
    f"latest AS ({_old_rosters('')})",
    "items AS (SELECT unnest([team || ': ' || position || ' = ' || player, team || ':' || lower(position) || '=' || player || '=x:y ', team || ':top=' || player, team || ' no role ' || player]) AS item FROM latest)",
)


def roster_complete(spark, d):
    """Teams whose latest roster can answer a request: every role has a player."""
    return serving.completeness(Q.latest_roster(spark, d), M.ROLES)


ROSTER_COMPLETE_SQL = M.sql(
    "SELECT team, count(DISTINCT position) AS filled, count(DISTINCT position) = 3 AS complete FROM (SELECT t.team, p.position FROM players p JOIN teams t USING (gameid, side)) GROUP BY team"
)


def meta_counts(spark, d):
    """What a server tells about itself: regions and numbers of games, teams and served teams."""
    g, h = M.stream(spark, d), Q.modal_home_region(spark, d)
    n = g.agg(F.count("*").alias("games"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"))
    teams = h.agg(F.count("*").alias("teams"), F.count(F.when(X.is_major(F.col("home"), M.MAJOR), 1)).alias("supported_teams"))
    return n.crossJoin(F.broadcast(teams)).withColumn("regions", F.lit(",".join(M.MAJOR)))


META_SQL = M.sql(f"SELECT (SELECT count(*) FROM games) AS games, (SELECT strftime(max(date), '%Y-%m-%d') FROM games) AS last_day, count(*) AS teams, count(*) FILTER (home IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')) AS supported_teams, '{','.join(M.MAJOR)}' AS regions FROM homes")


def meta_json(spark, d):
    """The same as one JSON text."""
    return as_json(meta_counts(spark, d).select("games", "last_day", "teams", "supported_teams", "regions"))


META_JSON_SQL = META_SQL.replace("SELECT (SELECT count(*) FROM games) AS games", "SELECT to_json({'games': games, 'last_day': last_day, 'teams': teams, 'supported_teams': supported_teams, 'regions': regions})::VARCHAR AS json FROM (SELECT (SELECT count(*) FROM games) AS games") + ")"


#: Home of the teams whose share is asked for.
SHARED_HOME = "AMERICA"


def share_of_set(spark, d):
    """Share of games of the event between regions in which a team of a set takes part."""
    g = M.stream(spark, d).filter((F.col("event") == "1-URGENT") & F.col("cross_region"))
    members = Q.modal_home_region(spark, d).filter(F.col("home") == SHARED_HOME)
    for side in ("blue", "red"):
        g = g.join(members.select(F.col("team").alias(f"{side}_team"), F.lit(True).alias(f"{side}_in")), f"{side}_team", "left")
    hit = F.coalesce("blue_in", F.lit(False)) | F.coalesce("red_in", F.lit(False))
    return g.agg(F.count("*").alias("games"), F.round(F.avg(hit.cast("double")), 6).alias("share"))


SHARE_SQL = M.sql(f"SELECT count(*) AS games, round(avg(CASE WHEN blue_team IN (SELECT team FROM homes WHERE home = '{SHARED_HOME}') OR red_team IN (SELECT team FROM homes WHERE home = '{SHARED_HOME}') THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share FROM games WHERE event = '1-URGENT' AND cross_region")


def season_lift(spark, d):
    """Accuracy above the better constant guess, by league, of leagues with ten games or more."""
    s = season_by_league(spark, d)
    return s.select("blue_league", "n", F.round(F.col("accuracy") - F.col("baseline") + 1e-9, 4).alias("lift"))


QUERIES = {
    "elo_replay": _rated(TEAM), "player_elo": _rated(PLAYER, True), "region_elo": _rated(REGION), "region_player_elo": _rated(PLAYER_RA, True),
    "elo_diff": (elo_diff, M.sql(f"SELECT gameid, round(diff + {TEAM.home}, 4) AS elo_diff FROM elo WHERE i > 0", fold_sql(TEAM).strip(), recursive=True)),
    "elo_stream": (elo_stream, _rated(TEAM)[1]), "elo_incremental": (elo_incremental, M.history_sql(_rated(TEAM)[1])), "rating_snapshots": (rating_snapshots, SNAPSHOT_SQL),
    "elo_grid": _grid(GRID, False), "region_grid": _grid(REGION_GRID, True, TUNED_BEFORE),
    "elo_leaderboard": (elo_leaderboard, M.sql("SELECT pool, name, round(rating, 4) AS rating, games FROM finals JOIN counts USING (pool, name) WHERE games >= 10 ORDER BY rating DESC, pool, name LIMIT 10", fold_sql(TEAM).strip(), _final("member", TEAM), COUNTS, recursive=True)),
    "region_rank": (region_rank, M.sql("SELECT name, round(avg(rating), 4) AS rating, count(*) AS pools FROM (SELECT pool, name, rating FROM finals UNION ALL SELECT DISTINCT pool, region, 1500.0 FROM (SELECT pool, blue_region AS region FROM games UNION ALL SELECT pool, red_region FROM games) x WHERE NOT EXISTS (SELECT 1 FROM finals f WHERE f.pool = x.pool AND f.name = x.region)) GROUP BY name", fold_sql(REGION).strip(), _final("region", REGION), recursive=True)),
    "point_metrics": (point_metrics, _sql(f"SELECT {_POINT} FROM scored")),
    "metrics_by_bucket": (metrics_by_bucket, _sql(f"SELECT slice, {_POINT} FROM (SELECT 'overall' AS slice, * FROM scored UNION ALL SELECT bucket, * FROM scored) GROUP BY slice")),
    "constant_baseline": (constant_baseline, _sql(f"SELECT {_POINT} FROM (SELECT target, (SELECT avg(target) FROM scored) AS p FROM scored)")),
    "auc_by_group": (auc_by_group, _sql(AUC_SQL)), "class_report": (class_report, _sql(CLASS_SQL)), "calibration_bins": (calibration_bins, _sql(CALIBRATION_SQL)), "mcnemar": (mcnemar, _sql(MCNEMAR_SQL)),
    "bootstrap_ci": (lambda s, d: _boot(_single())(s, d), _boot_sql({"accuracy": ["team_accuracy", "player_accuracy"], "log_loss": ["team_log_loss", "player_log_loss"]})),
    "paired_ci": (lambda s, d: _boot(_paired())(s, d), _boot_sql({"accuracy_difference": ["accuracy"], "log_loss_difference": ["log_loss"]})),
    "cumulative_accuracy": (cumulative_accuracy, _sql(CUMULATIVE_SQL)),
    "season_summary": (season_summary, _sql(f"SELECT {_POINT} FROM season", SEASON)),
    "season_by_league": (season_by_league, _sql(f"SELECT blue_league, {_POINT} FROM season GROUP BY 1 HAVING count(*) >= 10", SEASON)),
    "season_timeline": (season_timeline, _sql("SELECT row_number() OVER w AS i, strftime(date, '%Y-%m-%d') AS day, round(avg(CASE WHEN (p >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END) OVER w, 6)::DOUBLE AS cum_acc FROM season WINDOW w AS (ORDER BY date, gameid ROWS UNBOUNDED PRECEDING)", SEASON)),
    "recent_games_log": (recent_games_log, _sql(LOG_SQL, SEASON)),
    "teams_by_region": (teams_by_region, M.sql("SELECT home, string_agg(team, ',' ORDER BY team) AS teams FROM homes GROUP BY home")),
    "team_counts": (team_counts, M.sql("SELECT team, count(*) AS games FROM (SELECT blue_team AS team FROM games UNION ALL SELECT red_team FROM games) GROUP BY team")),
    "name_resolve": (name_resolve, RESOLVE_SQL), "matchup_features": (matchup_features, MATCHUP_SQL),
    "prediction_json": (prediction_json, None), "season_json": (season_json, _sql(SEASON_JSON_SQL, SEASON)), "rosters_overridden": (rosters_overridden, OVERRIDDEN_SQL),
    "name_suggest": (name_suggest, None), "roster_overrides": (roster_overrides, OVERRIDE_SQL), "roster_complete": (roster_complete, ROSTER_COMPLETE_SQL), "meta_counts": (meta_counts, META_SQL), "meta_json": (meta_json, META_JSON_SQL),
    "share_of_set": (share_of_set, SHARE_SQL), "season_lift": (season_lift, _sql(f"SELECT blue_league, n, round(accuracy - baseline + 1e-9, 4) AS lift FROM (SELECT blue_league, {_POINT} FROM season GROUP BY 1 HAVING count(*) >= 10)", SEASON)),
    "split_counts": (split_counts, SPLIT_COUNTS_SQL), "refit_model": (M.over_history(refit_model), None), "predict_matchup": (predict_matchup, None),
    "logreg_holdout": (M.over_history(logreg_holdout), None), "gbt_holdout": (M.over_history(gbt_holdout), None), "boosted_holdout": (M.over_history(boosted_holdout), None), "feature_importance": (M.over_history(feature_importance), None), "walk_forward": (M.over_history(walk_forward), None),
}
#: Registered as NAME_history as well, with ratings that are carried through all games.
CARRIED = (
    "elo_replay player_elo region_elo region_player_elo elo_diff elo_grid region_grid elo_leaderboard region_rank point_metrics metrics_by_bucket constant_baseline auc_by_group class_report "
    "calibration_bins mcnemar bootstrap_ci paired_ci cumulative_accuracy season_summary season_by_league season_timeline recent_games_log matchup_features"
).split()
QUERIES |= {f"{k}_history": (M.over_history(QUERIES[k][0]), M.history_sql(QUERIES[k][1])) for k in CARRIED}
