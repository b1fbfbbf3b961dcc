"""What long histories and many rows cost: jobs, scans, and digests by the thousand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import SF
from test_ratings import ANCHORED, SCHEMA, league, plain, rated

from contestflow.operators import learn, metrics, pairing
from contestflow.operators import ratings as R
from contestflow.plans import matchmodel as M


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines())


def test_the_stream_reads_lines_once(spark):
    games = M.ladder_games(M.stream(spark, SF))
    assert scans(games) == 1  # each side by itself before


def test_paired_equals_the_join_of_halves(spark):
    rows = [(1, "L", "a", None), (1, "R", "b", 2.0), (2, "L", "c", 1.0), (3, "R", "d", 1.0), (4, "R", None, float("nan")), (4, "L", "e", 5.0), (5, "x", "f", 1.0)]
    df = spark.createDataFrame(rows, "k long, side string, name string, v double")
    want, got = (sorted(map(str, f(df, "k", "side", "L", "R", ["name", "v"]).select("k", "blue_name", "blue_v", "red_name", "red_v").collect())) for f in (pairing.pair_sides, pairing.paired))
    assert got == want and len(got) == 2


def test_written_games_equal_the_stream(spark):
    same = M.stream(spark, SF).select("gameid", "blue_team", "blue_home", "red_lineup", "target", "pool")
    got = M.written_games(spark, SF).select(*same.columns)
    assert got.count() and not same.exceptAll(got).count() and not got.exceptAll(same).count()


def test_many_slices_are_one_run(spark):
    rows = league(8, 400, teams=9)
    history = R.History(spark.createDataFrame(rows, SCHEMA), 2)
    assert (history.steps, history.runs) == (200, 1)  # 200 jobs before
    out = history.fold([ANCHORED], R._tell_games)
    assert {x.step: x.n for x in out.filter("kind = 'told'").groupBy("step").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(200), 2)
    last = out.filter("kind <> 'told'").groupBy("kind", "name").agg(F.max_by("rating", "step").alias("r")).collect()
    assert {(x.kind, x.name): x.r for x in last} == plain(rows, ANCHORED)[1]


@pytest.mark.parametrize("ladder", [R.Ladder(), ANCHORED])
def test_runs_hand_ratings_on(spark, monkeypatch, ladder):
    monkeypatch.setattr(R, "RUN", 20)
    monkeypatch.setattr(R, "MERGE", 3)
    rows = league(14, 150, teams=7) + league(15, 33, pool="q")
    games = spark.createDataFrame(rows, SCHEMA)
    history = R.History(games, 5)
    assert (history.steps, history.runs) == (30, 8)
    for pool in ("p", "q"):
        mine = [x for x in rows if x[0] == pool]
        assert rated(R.replay(games, ladder, 5).filter(F.col("pool") == pool)) == plain(mine, ladder)[0]
        assert {(x.kind, x.name): x.rating for x in R.final_ratings(games, ladder, 5).filter(F.col("pool") == pool).collect()} == plain(mine, ladder)[1]


def test_ladders_are_dealt_to_tasks(spark):
    """One pool and many points: each task has some of them, each point all games."""
    rows = league(16, 90)
    ladders = [R.Ladder(k=float(k)) for k in range(9)]
    out = R.grid(spark.createDataFrame(rows, SCHEMA), ladders, size=40).collect()
    for x in out:
        p = [(o[0], y[-1]) for o, y in zip(plain(rows, ladders[x.point])[0].values(), sorted(rows, key=lambda y: (y[1], y[2])), strict=True)]
        assert x.games == 90 and x.log_loss == pytest.approx(-np.mean([np.log(v if y else 1 - v) for v, y in p]))


def test_digests_equal_the_library():
    from contestflow.operators.draws import Times, digests

    keys = ["1", "é€x", "", "q" * 80, "12345678", "y" * 51, "7" * 50]
    heads = ["42|0|", "42|99|", "42|499|", ""]
    order, found = digests(heads, keys)
    for head, digits in zip(heads, found, strict=True):
        for at, k in enumerate(order):
            text = hashlib.md5((head + keys[k]).encode()).hexdigest()
            assert [f"{x:08x}" for x in digits[:, at].tolist()] == [text[8 * j : 8 * j + 8] for j in range(4)]
    steps = [int(x, 16) for x in metrics.poisson_steps()]
    near = np.array([s + d for s in steps for d in (-1, 0, 1)], np.uint32).reshape(-1, 3)
    assert (Times(steps)(near) == np.searchsorted(np.array(steps), near, side="right")).all()


def test_bootstrap_shuffles_sums_not_draws(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).alias("g"), F.rand(3).alias("x"))
    out = metrics.bootstrap(df, "x", "k", 400, 7, ["g"])
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()  # a row and text for each digest before
    assert {(r.g, r.replicates) for r in out.collect()} == {(True, 400), (False, 400)}


def test_medians_hold_no_column_in_a_task(spark):
    df = spark.range(3001).select(
        F.rand(1).alias("a"), (F.col("id") % 3).cast("int").alias("ties"), F.when(F.col("id") % 2 == 0, F.randn(2)).alias("b"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") == 5, F.lit(float("nan"))).otherwise(F.rand(4)).alias("nan"), F.when(F.col("id") < 2, F.col("id") * 2.0).alias("two"), F.lit(7.0).alias("same")).localCheckpoint()
    want = df.agg(*[F.median(learn.known(c)).alias(c) for c in df.columns]).first().asDict()
    assert learn.medians(df, df.columns) == want
    assert learn.medians(df, df.columns, 0.0) == want  # bounds that miss the middle are widened
