import base64
import random
import string

import pytest

from loomwright.llm import language as g

LATIN, CYRILLIC, GREEK = string.ascii_lowercase, "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
HAN = "".join(chr(c) for c in range(0x4E00, 0x9FA5))


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return g.fit(docs), docs.where("lang is not null and text is not null").where(g.remainder(g.FOLDS) == g.HELD_OUT).select("text").collect()


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_long_foreign_texts_are_rejected(fitted):
    rng = random.Random(6)
    texts = [words(rng, letters, n) for letters in (LATIN, CYRILLIC, GREEK) for n in (40, 200, 1000, 5000) for _ in range(30)]
    texts += ["".join(rng.choice(HAN) for _ in range(n)) for n in (200, 3000, 20_000) for _ in range(30)]
    texts += [base64.b64encode(rng.randbytes(n)).decode() for n in (225, 3000, 100_000) for _ in range(30)]
    assert all(rejected for _, _, rejected in fitted[0].classify(texts))


def test_held_out_documents_stay(fitted):
    found = fitted[0].classify([r.text for r in fitted[1]])
    assert len(found) > 3000 and sum(rejected for _, _, rejected in found) <= 0.01 * len(found)
