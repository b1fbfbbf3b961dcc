"""Ranges of the suffix merge: hot starts, bounded samples, ranges cut twice."""

import random

import pytest
from test_dedup import removed

from contestflow.llm import suffixes


def paired(prose, n, header):
    """Pairs of texts that share a passage behind a header that all texts share."""
    return [(k, header + prose(k // 2, 60) + f" {k} " + prose(9000 + k, 12)) for k in range(n)]


def test_cuts_of_a_run():
    r = random.Random(3)
    for _ in range(300):
        ordered = sorted(bytes(r.choice(b"abc") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(0, 12)))
        splits = sorted({bytes(r.choice(b"abc") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(0, 9))})
        got = {i: k for k, a, b in suffixes.cut_at(ordered, splits) for i in range(a, b)}
        assert got == {i: sum(x <= s for x in splits) for i, s in enumerate(ordered)}


def test_a_common_start_is_parted_by_what_follows(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 16_000)
    seen = {}
    materialize = suffixes.materialize

    def watched(df, what):
        out = materialize(df, what)
        if what == "suffix-runs":
            rows = out.filter("range >= 0").selectExpr("range", "size(p) as n").groupBy("range").sum("n").collect()
            seen[what] = {r[0]: r[1] for r in rows}
        return out

    monkeypatch.setattr(suffixes, "materialize", watched)
    rows = paired(prose, 300, "h" * 94 + " ")
    assert sorted(map(tuple, suffixes.remove_repeats(documents(rows), 128).collect()), key=str) == removed(rows, 128)
    counts = seen["suffix-runs"]
    assert len(counts) > 8 and max(counts.values()) <= 2.5 * sum(counts.values()) / len(counts)


@pytest.mark.parametrize("length", [64, 128])
def test_ranges_cut_twice_equal_brute_force(documents, prose, monkeypatch, length):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 2000)
    monkeypatch.setattr(suffixes, "COARSE", 3)
    monkeypatch.setattr(suffixes, "RUN_ROWS", 40)
    monkeypatch.setattr(suffixes, "SALTS", 2)
    calls, refined = [], suffixes.refined
    monkeypatch.setattr(suffixes, "refined", lambda *a: calls.append(a[3]) or refined(*a))
    rows = paired(prose, 60, "h" * 70 + " ") + [(900 + k, prose(1, 80)) for k in range(6)] + [(950, "ab" * 400), (951, None)]
    assert sorted(map(tuple, suffixes.remove_repeats(documents(rows), length).collect()), key=str) == removed(rows, length)
    assert calls and calls[0] > 1


def test_joins_on_a_common_segment_can_be_split(spark, documents, prose, monkeypatch):
    """Spark splits a key's rows over tasks only where both sides of the join are plain sorted shuffles."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    materialize, sides = suffixes.materialize, {}

    def watched(df, what):
        out = materialize(df, what)
        if what in ("hits", "typed", "spans"):
            df.collect()
            lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
            sides[what] = sum("Sort [h1" in a and ("ShuffleQueryStage" in b or "AQEShuffleRead" in b) for a, b in zip(lines[:-1], lines[1:], strict=True))
        return out

    monkeypatch.setattr(suffixes, "materialize", watched)
    passage = prose(1, 60)[:300]
    rows = [(k, prose(2 + k, 3) + passage + prose(1000 + k, 3)) for k in range(100)] + [(2000 + k, prose(3000 + k // 2, 40)) for k in range(8)]
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out = suffixes.remove_repeats(documents(rows), 256).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, out), key=str) == removed(rows, 256)
    assert sides == {"hits": 2, "typed": 2, "spans": 2}
