"""Windows over few, long entities: ranges with a halo equal one window per entity."""

import random

import pytest
from pyspark.sql import functions as F

from contestflow.operators import metrics
from contestflow.operators import temporal as T


@pytest.fixture
def rows(spark):
    r = random.Random(4)
    data = [("hot" if k % 10 else f"e{k % 7}", k // 3, k, None if k % 11 == 0 else r.random(), r.choice(["A", "B", "C", None]), [r.randrange(6), r.randrange(6)]) for k in range(700)]
    data += [(None, 1, 1000, 1.0, "A", [1]), (None, 2, 1001, 2.0, "B", [1, 2])]
    return spark.createDataFrame(data, "e string, t int, k long, x double, v string, m array<int>").repartition(3)


def same(a, b):
    return sorted(map(str, (r.asDict() for r in a.collect()))) == sorted(map(str, (r.asDict() for r in b.collect())))


@pytest.mark.parametrize("window", [1, 5, 400])
def test_split_windows_equal_plain_ones(rows, window):
    assert same(*(T.trailing_mean(rows, ["x", "k"], ["e"], ["t", "k"], window, 1, split=s).withColumns({c: F.round(c, 9) for c in ("roll_x", "roll_k")}) for s in (False, True)))
    assert same(*(T.trailing_mode(rows, "v", ["e"], ["t", "k"], window, "mode", split=s) for s in (False, True)))
    assert same(*(T.overlap_with_previous(rows, F.col("m"), ["e"], ["t", "k"], "c", split=s) for s in (False, True)))


def test_a_hot_entity_is_the_work_of_several_tasks(rows):
    parts = T.ranged(rows, ["e"], ["t", "k"]).filter("e = 'hot'")
    assert parts.select("_part").distinct().count() >= 3
    halo = T.with_halo(T.ranged(rows, ["e"], ["t", "k"]), ["e"], ["t", "k"], 5).filter("_halo").groupBy("e", "_part").count().collect()
    assert halo and all(r["count"] <= 5 for r in halo) and sum(r.e == "hot" for r in halo) >= 2


def test_no_rows(rows):
    none = rows.limit(0)
    assert T.trailing_mean(none, ["x"], ["e"], ["t"], 3, 1, split=True).collect() == [] and T.trailing_mode(none, "v", ["e"], ["t"], 3, "m", split=True).collect() == []


def test_as_of_equals_a_search(spark):
    r = random.Random(6)
    events = [(r.choice(["hot", "hot", "a", None]), r.randrange(60), k, r.choice([None, 1, 2, 3])) for k in range(300)]
    asked = [(r.choice(["hot", "a", "b", None]), r.choice([*range(62), None]), k) for k in range(200)]
    out = T.as_of(spark.createDataFrame(asked, "key string, at int, n int"), spark.createDataFrame(events, "key string, at int, k int, x int"), ["key"], ["at"], ["at", "k"], ["x"])

    def search(key, at):
        found = [e for e in events if key is not None and at is not None and e[0] == key and e[1] < at]
        return max(found, key=lambda e: (e[1], e[2]))[3] if found else None

    assert {r.n: r.x for r in out.collect()} == {n: search(key, at) for key, at, n in asked}
    assert out.columns == ["key", "at", "n", "x"]


def test_bootstrap_draws_are_poisson_and_shared(spark):
    import hashlib
    import math

    r = random.Random(2)
    data = [(k, "big" if k < 50 else "small", r.random(), r.random()) for k in range(70)]
    out = metrics.bootstrap(spark.createDataFrame(data, "k long, g string, x double, y double"), ["x", "y"], "k", 10, 7, ["g"]).collect()
    steps = metrics.poisson_steps()
    for n in range(6):
        chance = (int(steps[n], 16) - (int(steps[n - 1], 16) if n else 0)) / 2**32
        assert abs(chance - math.exp(-1) / math.factorial(n)) < 1e-9
    means = {"x": [], "y": []}
    for rep in range(10):
        times = []
        for row in data[:50]:
            digits = hashlib.md5(f"7|{rep // 4}|{row[0]}".encode()).hexdigest()[8 * (rep % 4) :][:8]
            times.append(sum(digits >= s for s in steps))
        for at, name in ((2, "x"), (3, "y")):
            means[name].append(sum(t * row[at] for t, row in zip(times, data, strict=False)) / sum(times))
    assert {r.g for r in out} == {"big"} and {r.measure for r in out} == {"x", "y"} and all(r.replicates == 10 for r in out)
    for row in out:
        m = sorted(means[row.measure])
        assert row.lo == pytest.approx(m[0] + 0.225 * (m[1] - m[0])) and row.hi == pytest.approx(m[8] + 0.775 * (m[9] - m[8]))
