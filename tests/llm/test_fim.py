import hashlib
import re

import pytest
from pyspark.sql import functions as F

from contestflow.llm import fim

MARKS = ("<P>", "<S>", "<M>")


def plainly(doc_id, text):
    """(n, form, prefix chars, middle chars, output) of one document."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def odd_rows(prose):
    rows = [(k, prose(k, k % 40)) for k in range(200)]
    rows += [(1000 + k, t) for k, t in enumerate([None, "", "a", "\n", "<", "<P", "P>", "x<P>y", "<S>", "a<M", "tail <", "émilé \U0001f600 x\x00y\r\n z"] * 8)]
    rows += [(7, "same key, other text"), (7, "same key, other text"), (None, "no key"), (None, None), (2000, "a b " * 60_000), (2001, "z" * 300_000)]
    return rows


def test_equals_plain_python_and_comes_back(spark, documents, prose):
    rows = odd_rows(prose)
    df = documents(rows)
    out = fim.rearrange(df).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.back, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out)
    assert got == sorted((k is None, k or 0, t or "", plainly(k, t)) for k, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_clashing_columns(spark, prose):
    rows = [(k, prose(k, 9)) for k in range(20)]
    names = ["n", "form", "output", "_row", "_units", "_text", "_a", "_p", "_h0", "_form"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    out = fim.rearrange(df, prefix="fim_").collect()
    assert all(r[c] == f"own {c}" for r in out for c in names)
    assert {r.doc_id: r.fim_output for r in out} == {k: plainly(k, t)[4] for k, t in rows}
    replaced = fim.rearrange(df).collect()
    assert {r.doc_id: r.output for r in replaced} == {k: plainly(k, t)[4] for k, t in rows} and replaced[0]._units == "own _units"


def test_other_sentinels_and_shares(spark, prose):
    rows = [(k, prose(k, 12) + " <P>") for k in range(100)]
    marks = fim.Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    out = fim.rearrange(spark.createDataFrame(rows, "doc_id long, text string"), plain_percent=0, spm_percent=100, sentinels=marks)
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in got} == {"spm"} and all(r.output.startswith("<|suf|>") for r in got)
    assert {r.doc_id: r.back for r in got} == dict(rows)


def test_no_rows_and_the_plan(spark, documents):
    assert fim.rearrange(documents([])).collect() == []
    plan = fim.rearrange(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("form", [None, "psm"])
def test_restore_of_nulls(spark, form):
    df = spark.createDataFrame([(None, form)], "output string, form string")
    assert df.select(fim.restore(F.col("output"), F.col("form")).alias("x")).collect()[0].x is None
