"""Ratings that are carried through all games, against a plain loop."""

import pytest
from test_engine import SF

from contestflow.operators import ratings
from contestflow.plans import evaluation, registry
from contestflow.plans import matchmodel as M


def plain(spark, ladder, by_player=False):
    """[(gameid, p, diff)] and the state after all games."""
    rows = M.ladder_games(M.stream(spark, SF), by_player).orderBy("date", "gameid").collect()
    *out, state = ratings.play([(r.blue, r.red, r.blue_region, r.red_region, r.cross, r.target) for r in rows], ladder)
    return {r.gameid: o for r, o in zip(rows, out, strict=True)}, state


def test_matchups_have_the_ratings_after_all_games(spark):
    _, (member, _) = plain(spark, evaluation.PLAYER, True)
    rows = registry.QUERIES["matchup_features_history"][0](spark, SF).collect()
    assert rows and all(r.rating == pytest.approx(member.get(str(r.player), 1500.0), abs=1e-3) for r in rows)
    assert {str(r.player) for r in rows} <= set(member) and all(r.rating != 1500.0 for r in rows)


@pytest.mark.parametrize("size", [7, 50_000])
def test_slices_equal_one_replay(spark, size):
    ladder = ratings.Ladder(k=24.0, beta=1.0, k_region=8.0)
    games = M.over_history(lambda s, d: M.ladder_games(M.stream(s, d), True))(spark, SF).orderBy("date", "gameid").limit(60)
    rows = games.collect()
    *out, (member, region) = ratings.play([(r.blue, r.red, r.blue_region, r.red_region, r.cross, r.target) for r in rows], ladder)
    got = {r.gameid: (r.p, r.diff) for r in ratings.replay(games, ladder, size).collect()}
    assert got == {r.gameid: o for r, o in zip(rows, out, strict=True)}
    final = {(r.kind, r.name): r.rating for r in ratings.final_ratings(games, ladder, size).collect()}
    assert final == {("member", str(k)): v for k, v in member.items()} | {("region", k): v for k, v in region.items()}


def test_models_see_the_whole_history(spark):
    want, _ = plain(spark, evaluation.TEAM)
    frame = M.over_history(evaluation.model_frame)(spark, SF)
    got = {r.gameid: r.elo for r in frame.collect()}
    assert got and all(v == pytest.approx(want[k][1], abs=1e-9) for k, v in got.items())
    assert all(registry.QUERIES[k][0].__qualname__.startswith("over_history") for k in ("walk_forward", "logreg_holdout", "gbt_holdout", "feature_importance", "refit_model", "predict_matchup"))


def test_history_has_one_pool(spark):
    want, _ = plain(spark, evaluation.TEAM)
    rows = registry.QUERIES["elo_replay_history"][0](spark, SF).collect()
    assert {r.pool for r in rows} == {"all"} and sorted(r.gameid for r in rows) == sorted(want)
    assert all(r.p == pytest.approx(want[r.gameid][0], abs=1e-5) for r in rows)
