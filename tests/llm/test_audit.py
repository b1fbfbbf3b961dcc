import itertools
import re

from pyspark.sql import functions as F

from contestflow.llm import audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plainly(docs, labels, names="ABCDE"):
    """The audit by applying every order to the list of documents."""
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    rows = []
    for key, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and key > least[text]}
        own = [x for x in labels if key is not None and x[0] == key]
        rows.append((source or "", {k for k in names if bad[k]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        inside, sums = [r for r in rows if r[0] == part], dict.fromkeys(names, 0)
        for order in itertools.permutations(names):
            left = inside
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                failing = sum(letter in r[1] for r in inside)
                left = [r for r in left if letter not in r[1]]
                sums[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {letter} for r in inside), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(sums[order[step - 1]])
    return out


def tables(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in ("mask", "part", "hash", "n", "_text", "first", "salt", "rows")})
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("own") for c in ("good", "part", "salt", "mask")})


def got(df, keys=("part", "filter_order", "step")):
    return {tuple(r[k] for k in keys): [r[c] for c in COUNTS] for r in df.collect()}


def odd_documents(prose):
    long, upper = prose(1, 400), prose(2, 250).upper()
    docs = [(k, prose(k, 180 + k), ["web", "books", None, ""][k % 4]) for k in range(40)]
    docs += [(100 + k, long, "web" if k % 3 else "books") for k in range(30)] + [(90, long, "news"), (None, long, "web"), (None, long, "web")]
    docs += [(200 + k, t, "web") for k, t in enumerate([None, "", "", upper, upper + " #", "a " * 300, "A#" * 300, "x " * 70_000, long + " 5%"])]
    docs += [(300, long, "web"), (300, long, "web"), (300, long, "books"), (300, upper, "books"), (None, None, None), (None, "", "")]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 320, 2)] + [(100, None, 1), (101, 1, None), (101, 0, 0), (101, 1, 1), (None, 1, 1), (9999, 1, 1), (300, 1, 0), (300, 1, 0)]
    return docs, labels


def test_equals_every_order_applied(spark, prose):
    docs, labels = odd_documents(prose)
    out = audit.audit(*tables(spark, docs, labels))
    want = plainly(docs, labels)
    assert got(out) == want and len(want) == 600 * 4
    assert out.columns == ["part", "filter_order", "step", *COUNTS]


def test_own_filters_and_no_duplicates(spark, prose):
    docs, labels = odd_documents(prose)
    d, l = tables(spark, docs, labels)
    full = audit.failures(F.col("_text"))
    out = audit.audit(d, l, {k: full[k] for k in "DA"}, duplicates=None)
    assert got(out) == plainly(docs, labels, "AD") and out.count() == 2 * 2 * 4


def test_empty_tables(spark):
    d, l = tables(spark, [], [])
    assert audit.audit(d, l).collect() == []
    d, l = tables(spark, [(1, None, None)], [])
    assert got(audit.audit(d, l)) == plainly([(1, None, None)], [])


def test_survivors_are_counted_for_every_subset(spark):
    counts = spark.createDataFrame([("a", 0, 5, 1, 0), ("a", 3, 2, 2, 2), ("a", 4, 1, 0, 1), ("b", 7, 9, 0, 0)], "part string, mask int, rows long, good long, toxic long")
    rows = {r.part: r.asDict() for r in audit.survivors(counts, 3).collect()}
    for part, masks in {"a": {0: (5, 1, 0), 3: (2, 2, 2), 4: (1, 0, 1)}, "b": {7: (9, 0, 0)}}.items():
        for k, kind in enumerate(audit.KINDS):
            assert rows[part][kind] == [sum(v[k] for m, v in masks.items() if not m & s) for s in range(8)]
