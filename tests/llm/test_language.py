import math
import zlib

import numpy as np

from loomwright.llm import language as g

SCHEMA = "doc_id long, text string, lang string, source string, score int"
SAYINGS = {
    "aa": "kala mana tiku rapa lomi sana koru pali tamu neki",
    "bb": "schwer fluss grenz stark pfund dross klang brecht holz zwirn",
    "cc": "eau beaux queue jouir aieux veux quai loue aout ouie",
}


def corpus(n=240):
    rows = []
    for i in range(n):
        lang = sorted(SAYINGS)[i % 3]
        words = SAYINGS[lang].split()
        rows.append((i, " ".join(words[(i * k) % 10] for k in range(1, 3 + i % 20)) + ".", lang, "s", 0))
    return rows


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus()
    hard = [(1001, None, "aa", "s", 0), (1002, "12 !! \U0001f642", "aa", "s", 0), (1003, "字" * 200, None, "s", 0), (None, "kala mana", "aa", "s", 0), (1004, "kala mana tiku " * 300_000, None, None, 0), (1005, "", None, None, 0)]
    df = spark.createDataFrame(rows + hard, SCHEMA)
    model = g.fit(df)
    assert sorted(set(model.names)) == sorted(SAYINGS) and len(model.names) > 3
    out = {r.doc_id: r for r in g.identify(df, model).collect()}
    assert len(out) == len(rows) + len(hard)
    assert [i for i in sorted(x for x in out if x is not None and x < 1000) if out[i].held_out] == [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].lang_pred == lang and not out[i].rejected for i, _, lang, _, _ in rows)
    assert [(out[i].lang_pred, out[i].score, out[i].rejected) for i in (1001, 1002, 1005)] == [("und", 0.0, True)] * 3
    assert out[1003].rejected and out[1003].lang_pred in SAYINGS and out[None].held_out and out[1004].lang_pred == "aa"


def plain(model, text):
    """Nearest centroid, letter by letter and n-gram by n-gram, in plain Python."""
    code = [0]
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            code.append(ord(low))
        elif code[-1]:
            code.append(0)
    letters, counts = sum(x > 0 for x in code), [0] * g.WIDTH
    if not letters:
        return "und", 0.0, True
    code.append(0)  # the text's end, after a separator if it has one
    for k in range(len(code) - 1):
        two = (code[k] * 0x9E3779B1 % 2**32) ^ (code[k + 1] * 0x85EBCA77 % 2**32)
        grams = [two]
        if k + 2 < len(code):
            grams.append((two * 0xC2B2AE3D % 2**32) ^ (code[k + 2] * 0x27D4EB2F % 2**32))
        for h in grams:
            counts[((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 20] += 1
    x = [math.sqrt(c) * float(w) for c, w in zip(counts, model.idf, strict=True)]
    norm = math.sqrt(sum(v * v for v in x))
    scores = [sum(v * float(w) for v, w in zip(x, row, strict=True)) / norm for row in model.centroids.tolist()]
    best = max(scores)
    return {name for name, s in zip(model.names, scores, strict=True) if s >= best - 1e-5}, best, best < model.floors[min(letters.bit_length(), 40)]


def test_query_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = g.fit(docs)
    rows = {r.doc_id: r for r in g.op2_language_id(spark, tiny).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        names, score, _ = plain(model, text)
        assert rows[i].lang_pred in names and abs(rows[i].score - score) < 1e-4
        assert rows[i].rejected == (not text or rows[i].score < model.floors[min(g.histogram(text)[1].bit_length(), 40)])


def test_floors_come_from_texts_of_each_length():
    found = [(3, 0.2 + k / 1000) for k in range(1000)] + [(5, 0.5)]
    floors = g.limits(found)
    assert floors[2] == 0 and floors[3] == np.quantile([c for b, c in found if b == 3], g.LOW, method="lower") - g.ROUNDING and floors[4] == floors[3] and abs(floors[40] - floors[3]) < 2e-3 and floors[5] < 0.3  # one window is too few: measured with those of the next shorter length
    assert max(len(w) for w in g.windows("ab cd " * 50)) == 300 and [len(w) for w in g.windows("ab cd ")] == [6, 2, 3]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "kala", None, "s", 0)], SCHEMA)
    assert [r.lang_pred for r in g.identify(df, g.fit(df)).collect()] == ["und"]
    empty = df.limit(0)
    assert g.identify(empty, g.fit(empty)).count() == 0


def test_query_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = g.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97 and sum(r.rejected for r in rows) <= 0.01 * len(rows)
