import math
import re
import zlib

import numpy as np

from loomwright.llm import toxicity as t

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, toxic int"


def corpus(n=400):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = [f"the word number{i % 17} is calm here", "nothing to see now", f"a quiet line {i % 7}"]
        if bad:
            body[i % 3] = f"you are a {['zorgle', 'blimfy'][i % 2]} today"
        docs.append((i, ". ".join(body) + ".", "clash"))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_from_document_labels_and_finds_the_sentence(spark):
    docs, labels = corpus()
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    weights, bias = t.fit(df, known)
    rows = {r.doc_id: r for r in t.score(df, weights, bias).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in rows.items() if r.held_out) == held
    assert all(rows[i].predicted == y for i, y in labels)
    for i, text, _ in docs:
        if rows[i].predicted:
            assert any(x in text[rows[i].worst_start :][: rows[i].worst_length] for x in ("zorgle", "blimfy"))
    found = t.locate(df, weights, bias).collect()
    assert found and all("zorgle" in r.sentence or "blimfy" in r.sentence for r in found)


def test_noisy_or_gradient():
    bags, labels = [[[0], [1]], [[1]], [[0, 1], []], [[]]], [1, 0, 1, 0]
    w, b = t.train([t.packed(x) for x in bags], labels, 2)
    assert w[0] > 2 and w[0] > w[1] and b < -1
    assert np.isclose(t.noisy_or([0.5, 0.5]), 0.75) and t.noisy_or([]) == 0.0


def test_hard_rows(spark):
    docs, labels = corpus()
    hard = [(None, "you are a zorgle today", "x"), (9001, None, "x"), (9002, "", "x"), (9003, "12 !! ..", "x"), (9004, "calm words " * 50_000 + ". a zorgle", "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs + hard, DOCS)
    known = spark.createDataFrame(labels + [(None, 1), (5, None), (1, 0)], LABELS)
    weights, bias = t.fit(df, known)
    out = t.score(df, weights, bias)
    assert out.count() == len(docs) + len(hard)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[None].held_out and rows[None].predicted == 1
    assert [rows[i].score for i in (9001, 9002, 9003)] == [0.0] * 3 and rows[9004].predicted == 1
    assert t.score(df.limit(0), weights, bias).count() == 0
    nothing = t.fit(df, known.limit(0))
    assert nothing == ({}, None) and all(r.score == 0 for r in t.score(df, *nothing).collect())


def plain(weights, bias, text):
    """The noisy-or of a text's sentences, word by word."""
    left = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = set(re.findall(r"[^\W\d_]+", sentence))
        if words:
            z = bias + sum(weights.get(f, 0.0) for w in words for f in {w + "$"} | {w[:k] for k in (3, 4, 5, 6, 7) if len(w) > k})
            left *= 1 - 1 / (1 + math.exp(-z))
    return 1 - left


def test_query_against_brute_force(spark, tiny):
    docs, labels = (spark.read.parquet(f"{tiny}/{n}.parquet") for n in ("documents", "labels"))
    weights, bias = t.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = t.op7_toxicity_mil(spark, tiny).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and weights
    for r in rows:
        assert abs(r.score - plain(weights, bias, texts[r.doc_id])) < 1e-6
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_likelihood_falls_with_plain_gradient():
    """The packed sums are those of the plain definition: bags with and without features, by finite differences."""
    bags, labels = [[[0, 1], [1], []], [[], []], [[2]], [[0], [2], []]], [1, 0, 0, 1]

    def loss(w, b):
        out = 0.0
        for bag, y in zip(bags, labels, strict=True):
            q = math.prod(1 - 1 / (1 + math.exp(-(b + sum(w[i] for i in s)))) for s in bag)
            out -= t.POSITIVE * math.log(1 - q) if y else math.log(q)
        return out / len(bags)

    w, b = t.train([t.packed(x) for x in bags], labels, 3)
    assert loss(w, b) < 0.5 * loss(np.zeros(3), -4.0)
    at = loss(w, b)
    assert all(loss(w + 0.5 * d, b) > at - 0.05 for d in np.concatenate([np.eye(3), -np.eye(3)]))


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    assert t.within([(1, 5), (2, 9), (3, 4)], 10) == [1, 3]
    docs, labels = corpus()
    df, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    monkeypatch.setattr(t, "SAMPLE_BYTES", 12_000)
    weights, bias = t.fit(df, known)
    assert weights and bias is not None
    monkeypatch.setattr(t, "SAMPLE_BYTES", 10)
    assert t.fit(df, known) == ({}, None)


def test_query_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = t.op7_toxicity_mil(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.9
