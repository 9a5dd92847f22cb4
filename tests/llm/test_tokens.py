import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomwright.llm import tokens as t

VOCABULARIES = {n: t.vocabulary_text(t.default_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
ENCODERS = {n: (t.Encoder(v, dict.fromkeys(t.whole_tokens(v), 1) if n.startswith("byte") else None), Tokenizer.from_str(v)) for n, v in VOCABULARIES.items()}


def same(text):
    for mine, library in ENCODERS.values():
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.count(text) == len(ids)
        assert mine.ids(text) == b"".join(i.to_bytes(4, "little") for i in ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=40))
def test_latin_texts(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=25))
def test_any_texts(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  a", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "İSTANBUL Σας", "it's we'LL I'd", "é", "\x1c\x85\xa0x", "日本語 text", "1²³½"])
def test_chosen_texts(text):
    same(text)


def test_every_code_point():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        same("".join(f"a{c}b 1{c}2 !{c}" for c in part[:: 1 if at < 0x3000 else 13]))
        same("".join(part[::5]))


WORLD = [
    "It’s a curly quote – and “another” one…", "price 5 € or ¥ 700", "Съешь же ещё этих мягких французских булок, да выпей чаю", "敏捷的棕色狐狸跳过了懒狗。日本語のテキスト", "한국어 문장입니다 그리고 또",
    "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία ΣΑΣ Σ", "نص عربي مع أرقام ١٢٣", "emoji 👩‍👩‍👧 and 𝒜𝓁𝑔 𐍈", "e\u0301 A\u030a \u2003\u3000x İI", "<|endoftext|>текст<|startoftext|><|endoftext|>",
]


@pytest.mark.parametrize("text", WORLD)
def test_texts_of_the_world(text):
    same(text)
    same(text * 50)


def test_other_scripts_take_the_shortcut():
    """The dealt method counts texts outside Latin-1 too: the library's encode isn't called for them."""
    mine = ENCODERS["byte_bpe_50k.json"][0]
    for text in WORLD[:4]:
        pre, whole = mine.shares(text * 20)
        assert pre and whole, text
    for mine, _ in ENCODERS.values():
        library, mine.library = mine.library, type("NoEncode", (), {"normalizer": mine.library.normalizer})()
        try:
            assert all(mine.count(text) for text in WORLD)
        finally:
            mine.library = library


def test_shortcut_is_proved():
    found = t.whole_tokens(VOCABULARIES["byte_bpe_50k.json"])
    library = ENCODERS["byte_bpe_50k.json"][1]
    assert len(found) > 40_000
    for word in random.Random(1).sample(found, 300):
        assert len(library.encode(word, add_special_tokens=False).ids) == 1


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(t, "CACHE_ENTRIES", 50)
    mine = t.Encoder(VOCABULARIES["word_bpe_49k.json"])
    for k in range(500):
        mine.count(f"zq{k}xw")
        mine.ids(f"zq{k}xw")
    assert len(mine.counts) <= 52 and len(mine.packed) <= 52


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 100_000), (3, "é <|endoftext|>"), (4, "日本")]
    df = spark.createDataFrame([(d, x, 7) for d, x in rows], "doc_id long, text string, n_tokens int")
    library = ENCODERS["byte_bpe_50k.json"][1]
    want = sorted(((d, len((x or "").encode()), n := len(library.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x in rows), key=str)
    path = t.default_path("byte_bpe_50k.json")
    assert sorted((tuple(r) for r in t.count_tokens(df, path).collect()), key=str) == want
    assert t.count_tokens(df.limit(0), path).count() == 0


def test_query(spark, tiny):
    library = ENCODERS["byte_bpe_50k.json"][1]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = t.op6_token_counts(spark, tiny).collect()
    assert len(rows) == len(docs)
    assert all(r.n_tokens == len(library.encode(docs[r.doc_id], add_special_tokens=False).ids) for r in rows)
