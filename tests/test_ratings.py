"""Components, long chains of slices, and the store of ratings, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contestflow.operators import ratings as R
from contestflow.operators.components import components
from contestflow.operators.snapshots import RatingStore

SCHEMA = "pool string, date timestamp, gameid long, blue array<string>, red array<string>, blue_region string, red_region string, cross boolean, target int"
ANCHORED = R.Ladder(k=40, beta=1.0, k_region=8.0)


def league(seed, n, teams=5, leagues=1, pool="p"):
    """Games of leagues that share no member; two regions in each."""
    r, start = random.Random(seed), dt.datetime(2020, 1, 1)
    return [
        (pool, start + dt.timedelta(hours=k // 2), k, [f"{k % leagues}t{r.randrange(teams)}"], [f"{k % leagues}u{r.randrange(teams)}"], f"x{k % leagues}", f"y{k % leagues}", k % 4 == 0, r.randrange(2))
        for k in range(n)
    ]


def plain(rows, ladder):
    rows = sorted(rows, key=lambda x: (x[1], x[2]))
    *out, (member, region) = R.play([x[3:] for x in rows], ladder)
    return {x[2]: o for x, o in zip(rows, out, strict=True)}, {("member", k): v for k, v in member.items()} | {("region", k): v for k, v in region.items()}


def rated(df):
    return {x.gameid: (x.p, x.diff) for x in df.collect()}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(f"c{k:03}", f"c{k + 1:03}") for k in range(70)]
    links = chain + [("hub", f"s{k}") for k in range(50)] + [("alone", "alone"), ("a", "b"), ("b", "a"), ("a", "b"), (None, "x"), ("x", None)]
    random.Random(2).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    want = {f"c{k:03}": "c000" for k in range(71)} | {"hub": "hub"} | {f"s{k}": "hub" for k in range(50)} | {"alone": "alone", "a": "a", "b": "a"}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


@pytest.mark.parametrize("ladder", [R.Ladder(), ANCHORED])
def test_unconnected_leagues_run_side_by_side(spark, ladder):
    rows = league(5, 240, leagues=3) + league(6, 30, pool="short")
    games = spark.createDataFrame(rows, SCHEMA)
    whole, state = plain([x for x in rows if x[0] == "p"], ladder)
    history = R.History(games, 40, by_component=True, regions=ladder.k_region is not None)
    units = history.all_slices().groupBy("pool", "unit").agg(F.count("*").alias("n"), F.countDistinct(F.substring(F.col("blue")[0], 1, 1)).alias("leagues"), F.max("slice").alias("last")).collect()
    assert sorted((u.pool, u.n, u.leagues, u.last) for u in units) == [("p", 80, 1, 1)] * 3 + [("short", 30, 1, 0)]
    assert history.steps == 2  # three leagues of 80 games in slices of 40, not one of 240
    got = rated(R.replay(games.filter("pool = 'p'"), ladder, 40, by_component=True))
    assert got == whole
    final = {(r.kind, r.name): r.rating for r in R.final_ratings(games.filter("pool = 'p'"), ladder, 40, by_component=True).collect()}
    assert final == state


def test_small_components_share_units(spark):
    rows = league(7, 300, teams=1, leagues=50)
    history = R.History(spark.createDataFrame(rows, SCHEMA), 60, by_component=True)
    assert 1 <= history.all_slices().select("unit").distinct().count() <= 5
    assert rated(R.replay(spark.createDataFrame(rows, SCHEMA), R.Ladder(), 60, True)) == plain(rows, R.Ladder())[0]


def test_two_hundred_slices(spark):
    rows = league(8, 400, teams=9)
    assert rated(R.replay(spark.createDataFrame(rows, SCHEMA).repartition(4), ANCHORED, 2)) == plain(rows, ANCHORED)[0]


def test_several_ladders_share_one_slicing(spark):
    rows = league(9, 60)
    games = spark.createDataFrame(rows, SCHEMA).withColumns({"blue_lineup": F.array(F.col("blue")[0], F.lit("joker")), "red_lineup": F.col("red")})
    ladders = {"team": R.Ladder(), "anchored": ANCHORED, "lineup": R.Ladder(k=10.0, lineup=True)}
    by_lineup = [(*x[:3], [*x[3], "joker"], *x[4:]) for x in rows]
    for size in (1000, 25):
        out = {r.gameid: r for r in R.replay_all(games, ladders, size).collect()}
        for name, of in (("team", rows), ("anchored", rows), ("lineup", by_lineup)):
            assert {k: (r[f"{name}_p"], r[f"{name}_diff"]) for k, r in out.items()} == plain(of, ladders[name])[0]
    ends = {n: {(r.kind, r.name): r.rating for r in R.final_ratings_all(games, ladders, 25).filter(F.col("ladder") == n).collect()} for n in ladders}
    assert ends["lineup"] == plain(by_lineup, ladders["lineup"])[1] and ends["anchored"] == plain(rows, ANCHORED)[1]


def test_empty_games(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert R.replay(none, R.Ladder()).collect() == [] and R.final_ratings(none, R.Ladder(), by_component=True).collect() == []


def test_store_takes_new_and_late_games(spark, tmp_path):
    rows = league(10, 200) + league(11, 40, pool="q")
    late, early, tail = ([x for x in rows if x[2] == 131], [x for x in rows if x[2] < 150 and x[2] != 131], [x for x in rows if x[2] >= 150])
    store = RatingStore(spark, str(tmp_path / "store"), ANCHORED, size=20)
    with pytest.raises(ValueError, match="nothing stored"):
        store.rated()
    done = store.advance(spark.createDataFrame(early, SCHEMA))
    assert (done.new, done.replayed) == (len(early), len(early))
    done = store.advance(spark.createDataFrame(tail, SCHEMA))
    assert done.new == len(tail) and done.replayed == len(tail)  # from the last snapshot on
    done = store.advance(spark.createDataFrame(late, SCHEMA))
    assert done.new == 1 and len(tail) < done.replayed <= len(tail) + 1 + 40  # from the snapshot before it
    assert store.advance(spark.createDataFrame([], SCHEMA)) == type(done)(0, 0)
    for pool in ("p", "q"):
        mine = [x for x in rows if x[0] == pool]
        assert rated(store.rated().filter(F.col("pool") == pool)) == plain(mine, ANCHORED)[0]
        open_ = store.intervals().filter((F.col("pool") == pool) & F.col("until").isNull()).collect()
        assert {(r.kind, r.name): r.rating for r in open_} == plain(mine, ANCHORED)[1]
    for end in [r.last for r in store.slices().filter("pool = 'p' AND slice IN (1, 4)").collect()]:
        after = plain([x for x in rows if x[0] == "p" and (x[1], x[2]) <= (end.date, end.gameid)], ANCHORED)[1]
        asked = [("p", k, n, end.date + dt.timedelta(minutes=1)) for k, n in after] + [("p", "member", "nobody", end.date), ("p", "member", None, end.date)]
        out = store.ratings_as_of(spark.createDataFrame(asked, "pool string, kind string, name string, date timestamp")).collect()
        assert {(r.kind, r.name): r.rating for r in out} == after | {("member", "nobody"): 1500.0, ("member", None): 1500.0}


def test_stream_writes_the_state_of_who_plays(spark, tmp_path):
    from contestflow.streaming.replay import replay_stream

    start = dt.datetime(2020, 1, 1)
    rows = [("p", start + dt.timedelta(hours=k), k, [f"a{k}"], [f"b{k}"], "x", "y", False, k % 2) for k in range(150)]
    rows.append(("p", start + dt.timedelta(days=9), 500, ["a3"], ["b4"], "x", "y", False, 1))
    first = replay_stream(spark.createDataFrame(rows[:150], SCHEMA), R.Ladder(), str(tmp_path / "s"))
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in first.progress] == [301]  # all members and the mark
    out = replay_stream(spark.createDataFrame(rows[150:], SCHEMA), R.Ladder(), str(tmp_path / "s"), resume=True)
    assert rated(out) == plain(rows, R.Ladder())[0]
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in out.progress] == [3]


@pytest.mark.parametrize("size", [1000, 30])
@pytest.mark.parametrize("ladder", [R.Ladder(), ANCHORED])
def test_native_fold_equals_the_loop(spark, ladder, size):
    rows = [(*x[:3], [*x[3], "both"], x[4] if k % 5 else [*x[4], "both"], *x[5:]) for k, x in enumerate(league(12, 90))]
    out = R.final_ratings_native(spark.createDataFrame(rows, SCHEMA), ladder, size)
    want = plain(rows, ladder)[1]
    got = {(r.kind, r.name): r.rating for r in out.collect()}
    assert {k: v for k, v in got.items() if k[0] == "member" or ladder.k_region} == pytest.approx(want, abs=1e-9)
    plan = R.History(spark.createDataFrame(rows, SCHEMA)).fold_native(ladder)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
