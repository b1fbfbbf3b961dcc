"""Near-duplicates, repeated passages and linked vectors against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestflow.llm import graph, minhash, suffixes, vectors


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def bag(text, words=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else Counter()


def similar(a, b):
    both = sum((a & b).values())
    return sum(a.values()) > 0 and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8


def changed(text, *places):
    w = text.split()
    for p in places:
        w[p] = "changed"
    return " ".join(w)


def test_near_copies_equal_brute_force(documents, prose):
    rows = [(k, prose(k, 120)) for k in range(10)]
    rows += [(100 + k, changed(prose(k, 120), 7 * k % 110)) for k in range(10)]  # near: one word
    rows += [(200 + k, changed(prose(k, 120), 5, 30, 60, 90)) for k in range(5)]  # about the threshold
    rows += [(300, prose(3, 120)), (301, prose(3, 120)), (302, None), (303, ""), (304, " \n "), (305, "short text"), (306, "short text"), (307, prose(3, 60) * 400)]
    rows += [(400 + k, "again and again and again the same words here now " * 20 + f"end {k}") for k in range(6)]  # weights over 1
    out = {r.doc_id: r for r in minhash.near_duplicates(documents(rows)).collect()}
    bags = {d: bag(t) for d, t in rows}
    ids = sorted(bags)
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and similar(bags[a], bags[b])])
    assert {d: r.component_id for d, r in out.items()} == want
    first = {}
    for d in ids:
        first.setdefault(frozenset(bags[d].items()) if bags[d] else d, d)
    assert {d: r.class_id for d, r in out.items()} == {d: first[frozenset(bags[d].items()) if bags[d] else d] for d in ids}
    assert all(r.kept == (r.component_id == d) for d, r in out.items())


def test_members_below_the_threshold_of_the_leader_are_still_linked(documents, prose, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 8)
    monkeypatch.setattr(minhash, "BUCKET_BYTES", 4000)
    base = prose(1, 100)
    step = [base]
    for k in range(24):  # a chain: neighbours are near, the ends are not
        step.append(changed(step[-1], 4 * k, 4 * k + 1))
    rows = [(10 * k, t) for k, t in enumerate(step)]
    rows += [(1000 + k, changed(base, *range(k % 7, 100, 11))) for k in range(30)]  # alike below the threshold
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()}
    bags = {d: bag(t) for d, t in rows}
    ids = sorted(bags)
    assert out == components(ids, [(a, b) for a in ids for b in ids if a < b and similar(bags[a], bags[b])])


def test_signatures_estimate_weighted_jaccard():
    keys = np.arange(1, 401, dtype=np.uint64) * np.uint64(7919)
    a, b = np.repeat(np.int64(3), 400), np.where(np.arange(400) < 200, 3, 1)
    text = np.repeat([0, 1], 400)
    sig = minhash.bag_minhash(text, np.concatenate([keys, keys]), np.concatenate([a, b]), 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - b.sum() / a.sum()) < 0.06


def test_one_doc_id_with_different_texts_loses_no_link(documents, prose):
    a, b = prose(1, 120), prose(2, 120)
    rows = [(5, a), (5, b), (9, changed(b, 60)), (12, a), (3, changed(a, 50)), (20, b + " "), (20, b)]
    out = sorted(map(tuple, minhash.near_duplicates(documents(rows)).collect()))
    want = [(3, 3, 3, True), (5, 5, 3, False), (5, 5, 5, True), (9, 9, 5, False), (12, 5, 3, False), (20, 5, 5, False), (20, 5, 5, False)]
    assert out == want


def test_near_duplicates_odd_tables(documents):
    assert minhash.near_duplicates(documents([])).collect() == []
    rows = [(None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, None)]
    out = sorted(map(tuple, minhash.near_duplicates(documents(rows)).collect()), key=str)
    assert out == sorted([(None, None, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 2, 2, True)], key=str)


def removed(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [32, 64, 400])
def test_passages_equal_brute_force(documents, prose, monkeypatch, length):
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 6)
    monkeypatch.setattr(suffixes, "RUN_ROWS", 20)
    monkeypatch.setattr(suffixes, "PIECE_STARTS", 300)
    passage, other = prose(900, 90), "é☃" * 300
    rows = [(k, prose(k, 60) + passage[k : len(passage) - 3 * k] + prose(50 + k, 40)) for k in range(12)]
    rows += [(50, None), (51, ""), (52, "z" * 1000), (53, "ab" * 30), (54, other), (55, "x" + other + "y"), (56, passage * 3), (57, prose(7, 20)), (57, prose(7, 20))]
    rows += [(60 + k, passage) for k in range(9)]  # copies
    rows += [(80, prose(81, 200)), (81, prose(82, 200))]  # clean
    assert sorted(map(tuple, suffixes.remove_repeats(documents(rows), length).collect()), key=str) == removed(rows, length)


def test_passages_in_texts_longer_than_a_scan(documents, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "SCAN_BYTES", 3000)
    rows = [(1, prose(1, 4000)), (2, prose(2, 50) + prose(1, 4000)[9000:12000]), (3, "q" * 9000)]
    assert sorted(map(tuple, suffixes.remove_repeats(documents(rows), 64).collect()), key=str) == removed(rows, 64)


def test_passages_odd_tables(documents, prose):
    assert suffixes.remove_repeats(documents([])).collect() == []
    rows = [(None, prose(1, 100)), (None, prose(1, 100)), (4, prose(2, 100))]
    out = suffixes.remove_repeats(documents(rows), 64, with_text=True, carry=("source",)).collect()
    assert sorted((r.doc_id, r.kept_text, r.source) for r in out if r.doc_id is None) == [(None, "", "web")] * 2
    assert [r.kept_text for r in out if r.doc_id == 4] == [prose(2, 100)]


def test_loser_tree_merges_front_coded_runs():
    runs = [sorted(hashlib.md5(f"{r}{k % 9}".encode()).digest()[:3] * 2 for k in range(20)) for r in range(5)]
    coded = [suffixes.front_code(r)[0] for r in runs]
    merged = [(item[0], shared) for item, shared in suffixes.LoserTree(suffixes.decoded(c, len(r), k) for k, (c, r) in enumerate(zip(coded, runs, strict=True)))]
    assert [m[0] for m in merged] == sorted(sum(runs, []))
    assert all(s == suffixes.common_prefix(a[0], b) for a, (b, s) in zip(merged[:-1], merged[1:], strict=True))


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 16)
    monkeypatch.setattr(vectors, "SPREAD_ROWS", 20)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        rows += [(100 * c + k, (centre + rng.standard_normal(16) * 0.16).tolist(), c % 2) for k in range(30)]
    hot = rng.standard_normal(16).tolist()
    rows += [(1000 + k, hot, 0) for k in range(50)] + [(2000, [2 * x for x in hot], 0), (2001, hot, 1), (2002, hot, None)]
    rows += [(4000 + k, (np.array(hot) + (0.02 if k % 2 else -0.02)).tolist(), 1) for k in range(40)]  # copies of two near vectors
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [None] + hot[1:], 0), (3003, [float("nan")] + hot[1:], 0), (3004, [float("inf")] + hot[1:], 0), (3005, [], 0), (3006, [1.0, 0.0], 0), (3007, [1.0, 0.01], 0)]
    df = spark.createDataFrame([(i, v, y, 1) for i, v, y in rows], "vec_id long, embedding array<float>, label int, n long")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    good = {i: np.array(v, np.float32).astype(float) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: y for i, _, y in rows}

    def cosine(a, b):
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if a.size == b.size else -1

    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and cosine(good[a], good[b]) >= 0.98]
    degree = Counter(x for pair in links for x in pair)
    comp = components([r[0] for r in rows], links)
    assert len(links) > 1200 and out == {i: (degree[i], comp[i], comp[i] == i) for i in comp}
    assert vectors.near_duplicates(df.limit(0)).collect() == []
    same = df.unionByName(df.filter("vec_id < 20"))  # repeated rows are one vector each
    again = vectors.near_duplicates(same.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumns({c: F.lit(1) for c in ("id", "x", "f1", "dim", "many", "component")}))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in again.distinct().collect()) == sorted((i, *v) for i, v in out.items())


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(40, 0), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}
