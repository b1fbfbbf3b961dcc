"""Second-order boosting against a plain row-by-row version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestflow.operators import boosting, learn


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((700, 3)).round(2)
    x[:, 2] = r.integers(0, 3, 700)
    y = (x[:, 0] + (x[:, 2] == 1) * x[:, 1] + r.normal(0, 0.5, 700) > 0).astype(int)
    rows = [(i, *map(float, a), int(t)) for i, (a, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, target int")


def plain(x, y, edges, rounds, depth, rate, least, ridge):
    """Scores of the rows: every cut of every node is tried on the rows themselves."""
    margin = np.full(len(x), np.log(y.mean() / (1 - y.mean())))

    def leaf(g, h):
        return -rate * g.sum() / (h.sum() + ridge)

    def grow(rows, level, g, h, out):
        out[rows] = leaf(g[rows], h[rows])
        best, found = 1e-6, None
        for j in range(x.shape[1]) if level < depth else ():
            for e in edges[j]:
                low, high = rows[x[rows, j] <= e], rows[x[rows, j] > e]
                if min(h[low].sum(), h[high].sum()) < least:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (low, high)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                if gain > best + 1e-9:
                    best, found = gain, (low, high)
        for part in found or ():
            grow(part, level + 1, g, h, out)

    for _ in range(rounds):
        p, out = 1 / (1 + np.exp(-margin)), np.zeros(len(x))
        grow(np.arange(len(x)), 0, p - y, p * (1 - p), out)
        margin = margin + out
    return 1 / (1 + np.exp(-margin))


def test_equals_the_plain_version(spark, table):
    x, y, df = table
    found = learn.fit(df, ["a", "b", "c"], boosting.Boosting(rounds=4, depth=3, rate=0.3, rows=1.0, columns=1.0, bins=16, key="id"))
    scale = [found.figures[c] for c in "abc"]
    edges = [[e * s + m for e in es] for es, (_, m, s) in zip(found.model.getOrDefault("edges"), scale, strict=True)]
    edges = [[e + 1e-9 for e in es] for es in edges]
    want = plain(x, y, edges, 4, 3, 0.3, 3.0, 1.0)
    got = np.array([r.p for r in found.score(df).orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-4
    assert all(len(e) <= 15 for e in edges) and len(edges[2]) <= 3


def test_partitions_do_not_matter_and_models_are_stored(spark, table, tmp_path, monkeypatch):
    _, y, df = table
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)  # several tasks a pass
    monkeypatch.setattr(boosting, "REWRITE", 3)
    plan = boosting.Boosting(rounds=5, key="id")
    figures = learn.prepare(df, ["a", "b", "c"])
    one, other = (learn.Fitted(figures, plan.fit(learn.scaled(df.repartition(n, F.rand(n)), figures))) for n in (1, 5))
    assert one.model.getOrDefault("trees") == other.model.getOrDefault("trees")
    learn.save(one, f"file://{tmp_path}/m")
    again = learn.load(spark, f"file://{tmp_path}/m")
    assert again.weights() == one.weights() and sum(w for _, w in one.weights()) == pytest.approx(1)
    assert again.score(df).orderBy("id").collect() == one.score(df).orderBy("id").collect()
    p = np.array([r.p for r in one.score(df).orderBy("id").collect()])
    assert ((p >= 0.5) == y).mean() > 0.75


def test_columns_and_rows_per_tree(spark, table):
    _, _, df = table
    found = learn.fit(df, ["a", "b", "c"], boosting.Boosting(rounds=4, columns=0.4, key="id"))
    for t in found.model.forest():
        assert len(set(t.feature) - {-1}) <= 1  # a single column per tree
    share = boosting.draw(np.arange(100_000), 7) < 0.8
    assert abs(share.mean() - 0.8) < 0.01 and (share != (boosting.draw(np.arange(100_000), 8) < 0.8)).any()


def test_odd_rows(spark):
    schema = "a double, target int"
    odd = spark.createDataFrame([(None, 1), (float("nan"), 0), (1.0, None), *[(float(i), i % 2) for i in range(60)]], schema)
    found = learn.fit(odd, ["a"], boosting.Boosting(rounds=2))
    assert all(0 < r.p < 1 for r in found.score(odd).collect())
    sure = learn.fit(spark.createDataFrame([(float(i), 1) for i in range(50)], schema), ["a"], boosting.Boosting(rounds=2))
    assert all(r.p > 0.99 for r in sure.score(odd.filter("target is not null")).collect())
    with pytest.raises(ValueError, match="no rows"):
        learn.fit(spark.createDataFrame([(1.0, None)], schema), ["a"], boosting.Boosting(rounds=2))
