import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import near
from loomwright.llm.components import components


def word_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(docs, percent=85):
    """(component, set size) by row, from all pairs that share a shingle."""
    sets = [word_set(t) for _, t in docs]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    by = defaultdict(list)
    distinct = {}
    for (d, _), s in zip(docs, sets, strict=True):
        if s and d is not None:
            distinct.setdefault(s, []).append(d)
    classes = list(distinct.items())
    for ids in distinct.values():
        for d in ids:
            a, b = root(d), root(ids[0])
            up[max(a, b)] = min(a, b)
    for k, (s, _) in enumerate(classes):
        for x in s:
            by[x].append(k)
    seen = set()
    for k, (s, ids) in enumerate(classes):
        both = defaultdict(int)
        for x in s:
            for other in by[x]:
                if other < k:
                    both[other] += 1
        for other, n in both.items():
            t, theirs = classes[other]
            if 100 * n >= percent * (len(s) + len(t) - n) and (k, other) not in seen:
                a, b = root(ids[0]), root(theirs[0])
                up[max(a, b)] = min(a, b)
    return [(d, len(s), d if d is None or not s else root(d)) for (d, _), s in zip(docs, sets, strict=True)]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def family(rng, copies, words=120):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        out.append(" ".join(text))
    return out


def chain(rng, copies, words=120):
    """Each text is near to the one before it, few are near to the first."""
    text = [f"c{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(copies):
        text = list(text)
        text[(7 * k) % words] = f"y{k}"
        out.append(" ".join(text))
    return out


def test_large_clusters_compare_few_pairs(spark, monkeypatch):
    """Copies of one text are compared with it alone: no document of a star is in a second block."""
    monkeypatch.setattr(near, "BLOCK", 10)
    seen = []
    plain = near.confirm_links
    monkeypatch.setattr(near, "confirm_links", lambda docs, members, percent: (seen.append(members.count()), plain(docs, members, percent))[1])
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = [(0, " ".join(base))] + [(k, " ".join([*base, f"end{k}"])) for k in range(1, 101)]
    out = near.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.component_id for r in out.collect()} == {0}
    assert seen[0] <= 100 + 11 and sum(seen[1:]) == 0


@pytest.mark.parametrize("block", [512, 7])
def test_families_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BROADCAST_BYTES", 32_000_000 if block == 512 else 0)
    rng = random.Random(block)
    texts = [t for k in (1, 1, 1, 2, 3, 8, 40) for t in family(rng, k)] + chain(rng, 40) + ["same text here now ok"] * 30
    docs = list(enumerate(rng.sample(texts, len(texts))))
    docs += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE\x0btwo"), (905, "one two three"), (None, texts[0]), (3, dict(docs)[3]), (906, "é " * 40), (907, "long words " + "again and " * 60_000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, class string")
    assert got(near.near_duplicates(spark, df)) == sorted(brute(docs), key=str)


def test_two_texts_of_one_id_are_one_node(spark):
    rng = random.Random(9)
    a, b = ([t, "other " + t.split(" ", 1)[1]] for t in family(rng, 1) + family(rng, 1))
    docs = [(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1]), (4, "something else that is alone here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near.near_duplicates(spark, df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_empty(spark):
    assert near.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = near.op1_minhash_odd_sketches(spark, sf)
    assert got(rows) == sorted(brute(docs), key=str)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for j in (0.85, 0.9, 0.97):
        errors = []
        for _ in range(60):
            n = 2000
            shared = int(round(2 * n * j / (1 + j)))
            pool = near.mix(rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64))
            a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
            bits = int(np.bitwise_count(near.sketch(near.samples(a)) ^ near.sketch(near.samples(b))).sum())
            errors.append(1 + near.BITS / (4 * near.SAMPLES) * np.log(1 - 2 * bits / near.BITS) - j)
            assert bits <= near.differing()
        assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


@settings(deadline=None, max_examples=5)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    have = {(r.node, r.root) for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert have == {(x, root(x)) for x in list(up)}


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(200)]
    assert {r.root for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()} == {0}
