"""Names against full comparisons, incomplete rosters, nested JSON."""

import difflib
import json
import random

import pytest
from test_engine import SF

from contestflow.operators import serving
from contestflow.plans import evaluation


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.fixture
def names(spark):
    r = random.Random(9)
    catalog = sorted({"".join(r.choice("abcAB #1é") for _ in range(r.randrange(1, 14))).strip() for _ in range(160)} - {""})
    asked = sorted({"".join(r.choice("abcAB #1é😀") for _ in range(r.randrange(1, 14))).strip() for _ in range(60)} - {""}) + [catalog[3], catalog[5].swapcase(), "zzzzzzzzzz"]
    frames = [spark.createDataFrame([(n,) for n in x], "name string") for x in (asked, [*catalog, None])]
    return [*frames, sorted(set(asked)), catalog]


def test_suggestions_equal_the_full_comparison(names):
    asked_df, catalog_df, asked, catalog = names
    lower = {n.lower() for n in catalog}
    want = {a: ", ".join(difflib.get_close_matches(a, catalog, 5, 0.6)) for a in asked if a.lower() not in lower}
    out = serving.suggest(asked_df, catalog_df)
    assert {r.asked: r.suggestions for r in out.collect()} == want and sum(map(bool, want.values())) > 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_resolution_equals_the_full_comparison(names, spark):
    asked_df, catalog_df, asked, catalog = names
    known = spark.createDataFrame([(n,) for n in [*catalog, "ZZZZZZZZZZ"]], "name string")
    out = serving.resolve(asked_df, catalog_df, known, close=3)
    got = {r.asked: (r.how, r.resolved) for r in out.collect()}
    for a in asked:
        same = [n for n in catalog if n.lower() == a.lower()]
        near = [(edits(n.lower(), a.lower()), n) for n in catalog if edits(n.lower(), a.lower()) <= 3]
        if a in catalog:
            assert got[a] == ("exact", a)
        elif same:
            assert got[a] == ("case", min(same))
        elif a == "zzzzzzzzzz":
            assert got[a] == ("unsupported", None)
        else:
            assert got[a] == (("suggested", min(near)[1]) if near else ("unknown", None))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_incomplete_rosters_are_an_error(spark, monkeypatch):
    latest = evaluation.Q.latest_roster
    monkeypatch.setattr(evaluation.Q, "latest_roster", lambda s, d: latest(s, d).filter("team <> 'Brand#12' OR position <> 'N'"))
    with pytest.raises(serving.RequestError, match="incomplete rosters: Brand#12"):
        evaluation.matchup_rows(spark, SF, [("Brand#11", "Brand#12")])


def test_answers_as_nested_json(spark):
    rows = [json.loads(r.json) for r in evaluation.prediction_json(spark, SF).collect()]
    assert len(rows) == len(evaluation.MATCHUPS)
    for r in rows:
        assert r["blue"]["p"] + r["red"]["p"] == pytest.approx(1) and r["winner"] in (r["blue"]["team"], r["red"]["team"]) and set(r["ratings"]) == {"elo_diff", "pelo_diff"}
