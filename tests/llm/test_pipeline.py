"""The five stages, each on what its predecessor kept, against the plain versions."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from test_dedup import bag, components, removed, similar
from test_layout import counted, level_targets, plain_ids
from test_rules import plain

import corpus_pipeline as pipeline
from contestflow.llm import tokens
from contestflow.llm.common import materialize


def test_stages_equal_plain_versions(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    tables = [docs.collect()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = materialize(stage(spark, docs, d), "stage")
        assert k == 4 or docs.columns == spark.read.parquet(f"{d}/documents.parquet").columns
        tables.append(docs.collect())
    start, good, alone, cut, mixed, pieces = tables
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in start if plain(r.text)["kept"])
    bags = {r.doc_id: bag(r.text) for r in good}
    ids = sorted(bags)
    comp = components(ids, [(a, b) for a in ids for b in ids if a < b and similar(bags[a], bags[b])])
    assert sorted(r.doc_id for r in alone) == [k for k in ids if comp[k] == k]
    gone = {r[0]: r[2] for r in removed([(r.doc_id, r.text) for r in alone], pipeline.PASSAGE_BYTES)}
    before = {r.doc_id: r for r in alone}
    assert len(cut) == len(alone)
    for r in cut:
        raw = before[r.doc_id].text.encode()
        assert len(raw) - gone[r.doc_id] - 6 <= len(r.text.encode()) <= len(raw) - gone[r.doc_id] and (gone[r.doc_id] or r == before[r.doc_id])
    sizes, took = defaultdict(int), defaultdict(int)
    for r in cut:
        sizes[r.source] += counted(r.text)
    for r in mixed:
        took[r.source] += counted(r.text)
    goal, most = level_targets(sizes, (3, 1, 2), 1.5, 2), max(counted(r.text) for r in cut)
    assert all(abs(took[s] - goal[s]) <= 2 * most for s in sizes) and sum(took.values()) == int(1.5 * sum(sizes.values()))
    stream = [p for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in stream])
    packed = sorted(tuple(x) for x in np.split(ids, np.flatnonzero(ids == 1) + 1)[:-1])
    assert packed == sorted(tuple(plain_ids(tokens.WORD_BPE, r.text, 1)) for r in mixed)


def test_run_and_odd_tables(spark, prose, tmp_path):
    def folder(rows, name):
        (tmp_path / name).mkdir()
        full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        pq.write_table(full.toArrow(), tmp_path / name / "documents.parquet")
        return str(tmp_path / name)

    first, second = ("\n".join(" ".join(f"the {w}" for w in prose(s + k, 9).split()) + "." for k in range(12)) for s in (0, 50))
    assert pipeline.run(spark, folder([], "none")).collect() == []
    rows = [(None, first, None, None, None), (1, None, "en", "web", None), (2, second, "en", None, 5), (4, second + " end", "en", "web", 5), (5, second, "en", "web", 5), (3, "", "en", "web", 0)]
    assert pipeline.run(spark, folder(rows, "odd")).select("doc_id").distinct().count() == 2


def test_every_passage_of_over_fifty_words_goes(spark, prose):
    passage = " ".join(w[:4] for w in prose(1, 51).split())  # 51 words of four bytes at most
    texts = [f"{prose(10 + k, 80)} {passage} {prose(20 + k, 80)}" for k in range(3)] + [prose(40, 200)]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs, "").collect()}
    assert all(passage[2:-2] not in out[k] and prose(10 + k, 80)[:-9] in out[k] and prose(20 + k, 80)[9:] in out[k] for k in range(3)) and out[3] == texts[3]


def test_repeated_rows_and_rows_without_id(spark, prose):
    def text(seed):
        return "\n".join(" ".join(f"the {w}" for w in prose(seed + k, 9).split()) + "." for k in range(12))

    texts = [text(s) for s in (0, 50, 100, 150, 200)]
    rows = [(7, texts[0])] * 2 + [(None, texts[1])] * 3 + [(9, texts[2]), (9, texts[3]), (None, texts[4]), (12, texts[4]), (11, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    alone = [(7, texts[0]), (None, texts[1]), (9, texts[2]), (9, texts[3]), (11, texts[4])]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = materialize(stage(spark, docs, ""), "stage")
        got = docs.collect()
        if k in (1, 2):
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(alone, key=str)
        if k == 3:
            assert {(r.doc_id, t) for r in got for i, t in alone if i == r.doc_id and t.startswith(r.text)} == set(alone)
    starts = sorted((r.doc_id is None, r.doc_id) for r in got)
    assert {i for _, i in starts} == {7, 9, 11, None}


#: Names that stages and operators use inside, and those of their results.
INSIDE = "row key size taken words part rest _row _words _m _q_kept kept base_failed n_words _text doc th h1 h2 body p last spans component_id hash served mixed rank target source_size kept_text n_removed n_bytes whole at place ids width run block step _part _local _base rows stay first".split()


def test_no_stage_meets_a_column_of_the_input(spark, prose):
    def text(seed):
        return "\n".join(" ".join(f"the {w}" for w in prose(seed + k, 9).split()) + "." for k in range(12))

    rows = [(k, text(100 * (k % 8)), "en", ["web", "books", None][k % 3], 5) for k in range(12)] + [(50, "short", "en", "web", 5), (51, None, None, None, None)]
    plainly = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    extra = plainly.withColumns({c: pipeline.F.lit(f"own {c}") for c in INSIDE})
    for k, (_, stage) in enumerate(pipeline.STAGES):
        want, got = materialize(stage(spark, plainly, ""), "stage"), materialize(stage(spark, extra, ""), "stage")
        columns = plainly.columns if k < 4 else want.columns
        assert sorted(map(str, want.select(columns).collect())) == sorted(map(str, got.select(columns).collect()))
        if k < 2:  # later stages rewrite texts and give the columns of documents alone
            assert all(r[c] == f"own {c}" for r in got.collect() for c in INSIDE)
        if k < 3:
            plainly, extra = want, want.withColumns({c: pipeline.F.lit(f"own {c}") for c in INSIDE})
