"""Golden cases, no look-ahead, replays against a plain loop, every query against its SQL."""

import datetime as dt
import math
import random
from collections import Counter, deque

import duckdb
import pytest
from pyspark.sql import functions as F

from contestflow.functions import exprs as X
from contestflow.operators import learn, metrics, pairing, ratings, serving
from contestflow.operators import temporal as T
from contestflow.plans import evaluation, registry
from contestflow.sources import tables
from contestflow.streaming.replay import replay_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 4) + 0.0:.4f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [k for k, (_, sql) in registry.QUERIES.items() if sql])
def test_query_equals_sql(spark, duck, name):
    function, sql = registry.QUERIES[name]
    df = function(spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(sql)
    at = [d[0] for d in want.description]
    assert sorted(at) == cols
    got = sorted(tuple(shown(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == sorted(tuple(shown(r[at.index(c)]) for c in cols) for r in want.fetchall())


def rows_of(spark, values, kind="double"):
    return spark.createDataFrame([("e", k, v) for k, v in enumerate(values)], f"e string, t int, v {kind}")


def test_trailing_mean_and_mode_golden(spark):
    m = T.trailing_mean(rows_of(spark, [1.0, None, 3.0, 5.0, 7.0]), ["v"], ["e"], ["t"], 3, 2).orderBy("t")
    assert [r.roll_v for r in m.collect()] == [None, None, None, 2.0, 4.0]
    m = T.trailing_mode(rows_of(spark, list("ABACx"), "string"), "v", ["e"], ["t"], 3, "m").orderBy("t")
    assert [r.m for r in m.collect()][0::4] == ["A", "A"]


def test_trailing_mode_equals_a_counter(spark):
    r, rows, want = random.Random(3), [], {}
    for e in range(60):
        seen, held = deque(), Counter()
        for t in range(40):
            v = r.choice("ABCD")
            want[e, t] = max(held, key=held.get) if held else v  # first key of ties: insertion order
            seen.append(v)
            held[v] += 1
            if len(seen) > 5:
                old = seen.popleft()
                held[old] -= 1
                if not held[old]:
                    del held[old]
            rows.append((e, t, v))
    out = T.trailing_mode(spark.createDataFrame(rows, "e int, t int, v string"), "v", ["e"], ["t"], 5, "m")
    assert {(x.e, x.t): x.m for x in out.collect()} == want


def test_no_look_ahead(spark):
    def out(values):
        m = T.trailing_mean(rows_of(spark, values), ["v"], ["e"], ["t"], 4, 1)
        return [r.roll_v for r in m.orderBy("t").collect()]

    assert out([1.0, 2.0, 3.0, 4.0])[:4] == out([1.0, 2.0, 3.0, 99.0])[:4]


def test_expressions(spark):
    one = spark.range(1)
    null = F.lit(None).cast("double")
    r = one.select(
        X.safe_not(F.lit(None).cast("string").isin("a")).alias("a"), X.ratio(F.lit(2.0), F.lit(3.0), F.lit(0.0)).alias("b"), X.ratio(F.lit(2.0), F.lit(3.0), null).alias("c"),
        X.lookup(F.lit(None).cast("string"), {"a": "b"}).alias("d"), X.expected(F.lit(20.0)).alias("e"), X.hash_draw(42, F.lit(7), F.lit(3), F.lit(2**62)).alias("f"), X.lenient_number(F.lit("x")).alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.f, r.g) == (True, 5.0, None, "OTHER", 884981281890357, None) and abs(r.e - 0.5287505638922686) < 1e-15


def test_overlap_modal_and_predicates(spark):
    df = spark.createDataFrame([("t", 1, ["p", "q", "r"]), ("t", 2, ["p", "q", "s"])], "team string, t int, m array<string>")
    assert [r.c for r in T.overlap_with_previous(df, F.col("m"), ["team"], ["t"], "c").orderBy("t").collect()] == [None, 2]
    assert pairing.modal(rows_of(spark, ["b", "a", "c", "b", "a", None], "string"), ["e"], "v", "m").first().m == "a"
    assert pairing.with_distinct_values(rows_of(spark, ["b", "a", "b"], "string"), ["e"], "v", 2).count() == 3


@pytest.mark.parametrize("b, c, p", [(0, 0, 1.0), (1, 5, 0.21875), (7, 7, 1.0), (400, 900, None)])
def test_mcnemar(spark, b, c, p):
    got = spark.range(1).select(metrics.mcnemar(F.lit(b).cast("long"), F.lit(c).cast("long")).alias("p")).first().p
    want = p if p is not None else min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
    assert got == pytest.approx(want, rel=1e-6)


def test_auc_edges(spark):
    df = spark.createDataFrame([("one", 1, 0.2), ("one", 1, 0.3), ("flat", 1, 0.5), ("flat", 0, 0.5)], "g string, y int, p double")
    assert {r.g: r.auc for r in metrics.auc(df, "y", "p", ["g"]).collect()} == {"one": None, "flat": 0.5}
    assert [r.rank for r in T.average_rank(rows_of(spark, [0.1, 0.5, 0.5, 0.9]), "v").orderBy("t").collect()] == [1, 2.5, 2.5, 4]


def test_split_by_position(spark):
    s = T.split_by_position(spark.range(11), ["id"], 0.8)
    assert s.filter("is_train").agg(F.max("id"), F.count("*")).first()[:] == (7, 8)


def test_running_sums_equal_a_plain_loop(spark):
    r = random.Random(8)
    rows = [(k, r.choice("ab"), r.randrange(40), None if k % 7 == 0 else r.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, t int, x int").repartition(5)
    sums, want = {}, {}
    for k, g, _, x in sorted(rows, key=lambda v: (v[1], v[2], v[0])):
        n, s = sums.get(g, (0, 0))
        sums[g] = want[k] = (n + 1, s + (x or 0))
    out = T.running(df, ["t", "id"], {"n": F.lit(1), "s": F.col("x")}, "long", ["g"])
    assert {v.id: (v.n, v.s) for v in out.collect()} == want
    assert [v.seq for v in T.ordered_index(df, ["t", "id"]).orderBy("t", "id").collect()] == list(range(1, 501))
    assert T.running(df.limit(0), ["t"], {"n": F.lit(1)}).collect() == []


def test_bootstrap_leaves_small_groups_out(spark):
    df = spark.createDataFrame([("big" if k >= 29 else "small", float(k % 3), k - 29 if k >= 29 else k) for k in range(69)], "g string, x double, i long")
    out = metrics.bootstrap(df, "x", "i", 40, 7, ["g"]).collect()
    assert [(r.g, r.replicates) for r in out] == [("big", 40)] and out[0].lo <= 1.0 <= out[0].hi


def test_elo_golden():
    (p, gap), state = ratings.play([(["a"], ["b"], "x", "x", False, 1)], ratings.Ladder())
    assert abs(p - 0.5287505638922686) < 1e-15 and gap == 0 and state[0] == {"a": 1500 + 24 * (1 - p), "b": 1500 - 24 * (1 - p)}
    *_, (member, _) = ratings.play([(["a"], ["a"], "x", "x", False, 1)], ratings.Ladder())
    assert member == {"a": 1500.0}
    ladder = ratings.Ladder(k=40, beta=1.0, k_region=8.0)
    *_, (member, region) = ratings.play([(["a"], ["b"], "x", "y", True, 1)], ladder)
    assert set(member.values()) == {1500.0} and region["x"] > 1500 > region["y"]
    *_, (member, region) = ratings.play([(["a"], ["b"], "x", "OTHER", False, 1)], ladder)
    assert member["a"] > 1500 and set(region.values()) == {1500.0}


@pytest.fixture
def some_games(spark):
    r = random.Random(5)
    start = dt.datetime(2020, 1, 1)
    rows = [(f"p{k % 2}", start + dt.timedelta(hours=k), k, [f"t{r.randrange(5)}"], [f"u{r.randrange(5)}"], "x", "y", k % 3 == 0, r.randrange(2)) for k in range(80)]
    return spark.createDataFrame(rows, "pool string, date timestamp, gameid long, blue array<string>, red array<string>, blue_region string, red_region string, cross boolean, target int")


def test_stream_equals_batch_and_marks_late_rows(spark, some_games, tmp_path):
    ladder = ratings.Ladder(k=40, beta=1.0, k_region=8.0)
    batch = {r.gameid: (r.p, r.diff) for r in ratings.replay(some_games, ladder).collect()}
    out = replay_stream(some_games.coalesce(1), ladder, str(tmp_path / "whole")).collect()
    assert {r.gameid: (r.p, r.diff) for r in out} == batch and not any(r.late for r in out)
    twice = some_games.filter("gameid >= 40").coalesce(1).union(some_games.filter("gameid < 40").coalesce(1))
    out = replay_stream(twice, ladder, str(tmp_path / "late"), 1).collect()
    assert len(out) == 80 and all((r.p is None) == r.late for r in out)


def test_grid_keeps_the_first_of_ties(some_games):
    g = ratings.grid(some_games, [ratings.Ladder(k=10.0), ratings.Ladder(k=10.0), ratings.Ladder(k=0.0, home=0.0)]).orderBy("best").collect()
    assert [x.games for x in g] == [80] * 3 and abs([x for x in g if x.point == 2][0].log_loss - math.log(2)) < 1e-12
    assert [x.best for x in g] == [1, 2, 3] and [x.point for x in g if x.point < 2] == [0, 1]


def test_grid_scores_games_before_a_day(some_games):
    ladders = [ratings.Ladder(k=40.0, beta=b, k_region=8.0) for b in (0.0, 1.0)]
    rows = some_games.orderBy("date").collect()
    got = ratings.grid(some_games, ladders, score_before="2020-01-03", cross_only=True).orderBy("point").collect()
    for x, ladder in zip(got, ladders, strict=True):
        losses = []
        for pool in ("p0", "p1"):
            mine = [r for r in rows if r.pool == pool]
            *out, _ = ratings.play([(r.blue, r.red, r.blue_region, r.red_region, r.cross, r.target) for r in mine], ladder)
            losses += [-math.log(p if r.target else 1 - p) for (p, _), r in zip(out, mine, strict=True) if r.cross and r.date < dt.datetime(2020, 1, 3)]
        assert x.games == len(losses) and x.log_loss == pytest.approx(sum(losses) / len(losses))


def test_models(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, x := r.gauss(0, 1), None if k % 9 == 0 else r.gauss(0, 1), None, int(x + r.gauss(0, 0.3) > 0)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, empty double, target int")
    for estimator in (learn.logistic(400), learn.boosted(5)):
        fitted = learn.fit(df, ["a", "b", "empty"], estimator)
        assert fitted.score(df).filter((F.col("p") >= 0.5) == (F.col("target") == 1)).count() > 340 and [w[0] for w in fitted.weights()] == ["a", "b"]
        learn.save(fitted, f"file://{tmp_path}/{type(estimator).__name__}")
        again = learn.load(spark, f"file://{tmp_path}/{type(estimator).__name__}")
        assert again.figures == fitted.figures and again.weights() == fitted.weights()
        assert again.score(df).orderBy("id").select("p").collect() == fitted.score(df).orderBy("id").select("p").collect()
    figures = learn.prepare(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "a double"), ["a"])
    assert list(figures) == ["a"] and figures["a"][0] == 2.5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        learn.load(spark, f"file://{tmp_path}/nothing")


def test_logistic_minimises_the_stated_loss(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = r.standard_normal((300, 2))
    y = (x[:, 0] + r.standard_normal(300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, target int")
    fitted = learn.fit(df, ["a", "b"], learn.logistic(300))
    z = (x - x.mean(0)) / x.std(0)

    def slope(w, c):
        p = 1 / (1 + np.exp(-(z @ w + c)))
        return z.T @ (p - y) + w, (p - y).sum()  # the sum of losses plus half the squared norm

    gradient, constant = slope(fitted.model.coefficients.toArray(), fitted.model.intercept)
    assert np.abs(gradient).max() < 0.02 and abs(constant) < 0.02


def test_suggestions_equal_the_library(spark):
    import difflib

    names = ["Brand#11", "Brand#12", "Brand#21", "brand#13", "Brnd 11", "Zeta", "Brand#111"]
    asked = ["Brandd#11", " Brand#1 ", "zeta", "nothing like it", "Brand#12"]
    frames = [spark.createDataFrame([(n,) for n in x], "name string") for x in (asked, names)]
    want = {a.strip(): ", ".join(difflib.get_close_matches(a.strip(), names, 5, 0.6)) for a in asked if a.strip().lower() not in {n.lower() for n in names}}
    assert {r.asked: r.suggestions for r in serving.suggest(*frames).collect()} == want


def test_overrides_and_complete_rosters(spark):
    items = ["T1: top = Zeus", "T1:TOP=a=b:c", "T1:nowhere=x", "T1 top", None, "T1:top="]
    out = serving.parse_overrides(spark.createDataFrame([(i,) for i in items], "item string"), ["TOP", "MID"])
    assert {r.item: r[1:] for r in out.collect()} == {
        items[0]: ("T1", "TOP", "Zeus", None), items[1]: ("T1", "TOP", "a=b:c", None), items[2]: (None, None, None, "unknown role"),
        items[3]: (None, None, None, "no role=player"), None: (None, None, None, "no role=player"), items[5]: ("T1", "TOP", "", None),
    }
    rosters = spark.createDataFrame([("a", "TOP", "x"), ("a", "MID", "y"), ("b", "TOP", "x"), ("b", "MID", None)], "team string, position string, player string")
    assert {r.team: (r.filled, r.complete) for r in serving.completeness(rosters, ["TOP", "MID"]).collect()} == {"a": (2, True), "b": (1, False)}


def test_matchups_with_the_model(spark):
    rows = evaluation.predict_matchup(spark, SF).collect()
    assert len(rows) == len(evaluation.MATCHUPS)
    for r in rows:
        assert r.p_blue + r.p_red == pytest.approx(1) and r.confidence == max(r.p_blue, r.p_red) and r.winner == (r.blue if r.p_blue >= 0.5 else r.red)
    assert next(r for r in rows if r.match == 2).blue == "Brand#5"
    with pytest.raises(serving.RequestError):
        evaluation.matchup_rows(spark, SF, [("Brand#11", "brand#11 ")])
    with pytest.raises(serving.RequestError, match="Brand#99"):
        evaluation.matchup_rows(spark, SF, [("Brand#11", "Brand#99")])
    plain = evaluation.matchup_rows(spark, SF).filter("match = 0").first()
    new = evaluation.matchup_rows(spark, SF, changes=[("Brand#11", "A", "nobody")]).filter("match = 0").first()
    assert new.diff_A_roll_quantity is None and new.diff_A_career < plain.diff_A_career and new.diff_N_roll_quantity == plain.diff_N_roll_quantity and new.pelo != plain.pelo


def test_serving(spark):
    with pytest.raises(serving.RequestError):
        serving.check_request("A", "a ", 10)
    with pytest.raises(serving.RequestError):
        serving.check_request("A", "B", 51)
    rosters = spark.createDataFrame([("t", "top", "a"), ("t", "mid", "b")], "team string, position string, player string")
    new = serving.override(rosters, spark.createDataFrame([("t", "top", "z")], "team string, position string, player string"))
    rated = serving.with_default(new, spark.createDataFrame([("b", 1600.0)], "name string, rating double"), "player")
    assert sorted((r.player, r.rating) for r in rated.collect()) == [("b", 1600.0), ("z", 1500.0)]


def test_sources(spark, tmp_path):
    head = [c.strip().split(" ")[0] if "`" not in c else "earned gpm" for c in tables.RAW_SCHEMA.split(", ")]
    for year, date in (("2023", "2023-05-01 10:00:00"), ("2024", "no date")):
        values = {"gameid": f"g{year}", "date": date, "patch": "13.10", "result": "1", "kills": "2"}
        (tmp_path / f"{year}.csv").write_text(",".join(head) + "\n" + ",".join(values.get(h, "") for h in head) + "\n")
    df = tables.read_raw(spark, [str(tmp_path / "2023.csv"), str(tmp_path / "2024.csv")], ["gameid", "date", "patch", "deaths"])
    got = {r.gameid: (r.date, r.patch, r.deaths) for r in df.collect()}
    assert got == {"g2023": (dt.datetime(2023, 5, 1, 10), 13.1, None), "g2024": (None, 13.1, None)}
    tables.write_by_year(df.dropna(subset=["date"]), str(tmp_path / "years"))
    assert tables.read_years(spark, str(tmp_path / "years"), [2023]).count() == 1 and tables.read_years(spark, str(tmp_path / "years"), [2020]).count() == 0
    tables.save_state(df, str(tmp_path / "state"))
    assert tables.load_state(spark, str(tmp_path / "state")).count() == 2 and "g2023" in tables.as_json(df).orderBy("json").first().json + tables.as_json(df).orderBy(F.desc("json")).first().json
    kept = tables.written(df, "some")
    assert kept.count() == 2
    tables.clean(spark)
    with pytest.raises(Exception, match="NOT_EXIST|FileNotFound|does not exist"):
        kept.collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_state(spark, str(tmp_path / "nothing")).count()
