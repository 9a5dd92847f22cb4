import random

import pytest
from tests.llm.test_near import brute, word_set

import corpus_pipeline as c
from loomwright.llm import near


def roots(docs, percent):
    """Component by doc_id, from all pairs of texts; ids may be shared."""
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, word_set(t)) for d, t in docs]
    for k, (d, s) in enumerate(sets):
        for e, t in sets[:k]:
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) and root(d) != root(e):
                n = len(s & t)
                if 100 * n >= percent * (len(s) + len(t) - n):
                    a, b = root(d), root(e)
                    up[max(a, b)] = min(a, b)
    return {d: root(d) for d in up}


def roots_with_ids(docs):
    return {d: c for d, _, c in brute(docs)}


def cut(text, words):
    """The text without its last words: of n shingles so many go."""
    return " ".join(text.split()[:-words])


def texts(seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(12):
        base = " ".join(f"w{rng.randrange(9000)}" for _ in range(204))  # 200 shingles
        out += [base, cut(base, 40 if k % 2 else 34 + k % 5), cut(base, 41)]  # 0.80, 0.81 to 0.83; 0.795
    return list(enumerate(rng.sample(out, len(out))))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_each_threshold_against_brute_force(spark, percent):
    docs = texts()
    assert {r.doc_id: r.component_id for r in near.near_duplicates(spark, frame(spark, docs), percent).collect()} == roots(docs, percent)


def test_pipeline_drops_what_is_similar_by_80_percent(spark):
    docs = texts()
    df = frame(spark, docs)
    left = {r.doc_id for r in c.drop_near_duplicates(spark, df, "").collect()}
    want = roots(docs, 80)
    assert left == {d for d, r in want.items() if d == r} < {d for d, r in roots(docs, 85).items() if d == r}


def test_pipeline_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = roots([(r.doc_id, r.text) for r in df.collect()], 80)
    assert {r.doc_id for r in c.drop_near_duplicates(spark, df, "").collect()} == {d for d, r in want.items() if d == r}


def test_copies_under_shared_ids_join_their_classes(spark):
    rng = random.Random(8)
    a, b, d = (" ".join(f"w{rng.randrange(9000)}" for _ in range(100)) for _ in range(3))
    docs = [(3, a), (5, a), (5, b), (6, cut(b, 5)), (7, b), (8, a), (9, d), (10, b), (10, d), (11, "alone in all of this")]
    rows = near.near_duplicates(spark, frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted((i, roots_with_ids(docs)[i]) for i, _ in docs)
    assert {r.component_id for r in rows} == {3, 11}


def test_bands_find_pairs_at_the_threshold():
    assert [near.bands(p) for p in (80, 85)] == [22, 16]
    for percent in (75, 80, 85, 90, 99, 100):
        assert (1 - (percent / 100) ** near.ROWS) ** near.bands(percent) <= near.MISSED
    with pytest.raises(ValueError, match="too few"):
        near.bands(30)
