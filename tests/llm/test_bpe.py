import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contestflow.llm import bpe
from contestflow.llm.tokens import BYTE_BPE, WORD_BPE, vocabulary

NAMES = [WORD_BPE, BYTE_BPE]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def plainly(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def long_texts():
    r = random.Random(5)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    yield from (letters, "a" * 2003, "ab" * 1001 + "c", "the" * 900 + " end", "日本語" * 400, "é́" * 700, "É" * 801 + "x", "=" * 999 + "-" * 998, "7" * 1500, "\U0001f600" * 300)
    yield from ("x" * 700 + "<|endoftext|>" + "y" * 701 + "<|startoftext|>", " \n\t" * 500, " " * 700, "it's" * 300, "word  " * 200 + letters, "\x1c" * 600, "ſKİΣ" * 200)
    yield " ".join(letters[k : k + r.randrange(1, 400)] for k in range(0, 3000, 97))


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_parts_and_joins_equal_the_library(name, leaf):
    t, c = library(name), bpe.codec(name)
    for text in long_texts():
        kinds, payloads = zip(*c.parts(text, leaf), strict=True)
        ids = c.assemble(kinds, c.encode_parts(kinds, payloads))
        assert bpe.np.frombuffer(ids, c.encoder.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text[:30]
    assert {bpe.INNER, bpe.LAST} <= {k for x in long_texts() for k, _ in c.parts(x, leaf)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abth'é́ \n1<|>endoftxK-", min_size=1, max_size=60), st.integers(1, 5), st.sampled_from(NAMES))
def test_any_text_in_parts(text, leaf, name):
    c = bpe.codec(name)
    parts = list(c.parts(text, leaf))
    kinds, payloads = zip(*parts, strict=True)
    got = bpe.np.frombuffer(c.assemble(kinds, c.encode_parts(kinds, payloads)), c.encoder.dtype).tolist()
    t = library(name) if name not in _kept else _kept[name]
    _kept[name] = t
    assert got == t.encode(text, add_special_tokens=False).ids


_kept: dict = {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), min_size=1, max_size=8), st.text(alphabet="abc", min_size=2, max_size=80), st.integers(1, 79))
def test_join_with_any_merges(pairs, text, at):
    """Merges over random pairs of what is there already, against the whole text in one."""
    from tokenizers import models

    vocab, merges = {x: k for k, x in enumerate("abc")}, []
    pool = list("abc")
    for k, (a, b) in enumerate(pairs):
        left, right = pool[(ord(a) + k) % len(pool)], pool[(ord(b) * (k + 1)) % len(pool)]
        if left + right not in vocab:
            vocab[left + right] = len(vocab)
            merges.append((left, right))
            pool.append(left + right)
    model = models.BPE(vocab=vocab, merges=merges)

    def ids(x):
        return [t.id for t in model.tokenize(x)]

    joiner = bpe.Joiner(ids, ids, {i: t for t, i in vocab.items()})
    at = min(at, len(text) - 1)
    assert joiner.join(ids(text[:at]), ids(text[at:]), True) == ids(text)
    assert joiner.tree([ids(x) for x in bpe.halves(text, 3)]) == ids(text)


@pytest.mark.parametrize("name", NAMES)
def test_the_join_grows_as_far_as_it_must(name):
    c = bpe.codec(name)
    text = "a" * 4003  # runs of eight from the left: a cut elsewhere shifts all that follows
    left, right = (c.joiner.inner(text[:1001]), c.joiner.last(text[1001:]))
    assert c.joiner.join(left, right, True) == c.joiner.last(text)


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, documents, prose, name):
    rows = [(k, prose(k, k)) for k in range(60)] + [(100 + k, x) for k, x in enumerate(long_texts())]
    rows += [(None, "no key"), (None, None), (7, "again"), (7, "again"), (300, ""), (301, None), (302, "A <|endoftext|>b<|ENDOFTEXT|>"), (303, "a" * 40_001), (304, prose(9, 9000))]
    df = documents(rows).withColumns({c: F.lit("own") for c in ("row", "seq", "kind", "ids", "payload", "n_tokens")}).repartition(5)
    out = bpe.decode(bpe.encode(df, name, split=500, leaf=50), name).withColumn("sha", F.sha2("text", 256)).collect()
    t = library(name)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.sha) for r in out)
    assert got == sorted((str(k), *plainly(t, x)) for k, x in rows)
    one = bpe.encode(df, name).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    assert one.n == len(rows) and one.t == sum(plainly(t, x)[0] for _, x in rows)


def test_no_rows(spark, documents):
    assert bpe.decode(bpe.encode(documents([]))).collect() == []


def test_query_equals_the_library(spark):
    from contestflow.llm.common import table

    t, d = library(WORD_BPE), "/root/testdata/sf0.001"
    want = {r.doc_id: plainly(t, r.text) for r in table(spark, d, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_bpe(spark, d).collect()}
    assert got == want
