import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomwright.llm import packing
from loomwright.llm.packing import CAPACITY, op9_best_fit_packing, pack, plan
from loomwright.llm.tokens import default_path


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - n)
    return len(rooms)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_plan_is_best_fit(lengths):
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    lines = plan(counts, 16)
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in lines:
        for k in range(n):
            filled[first + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    assert len(filled) == best_fit(lengths, 16)


def verify(rows, docs, fewest):
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want = defaultdict(int)
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), CAPACITY)):
            part = ids[at : at + CAPACITY]
            want[doc, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(sequences) == fewest([k[3] for k, n in want.items() for _ in range(n)])


def test_hard_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "word " * 9000), (5, "<|endoftext|> İ 你好")]
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, length long")
    verify(pack(spark, df, default_path("word_bpe_49k.json")).collect(), docs, lambda n: best_fit(n, CAPACITY))
    assert pack(spark, df.limit(0), default_path("word_bpe_49k.json")).count() == 0


def test_small_blocks(spark, tiny, monkeypatch):
    """Many blocks of ranks, lines that are cut, and one hot length."""
    monkeypatch.setattr(packing, "RANKS", 4)
    monkeypatch.setattr(packing, "LONGEST", 3)
    docs = [(i % 7, "word " * (i % 3)) for i in range(300)] + [(None, None)] * 100
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    verify(pack(spark, df, default_path("word_bpe_49k.json"), CAPACITY).collect(), docs, lambda n: best_fit(n, CAPACITY))


def test_query(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    verify(op9_best_fit_packing(spark, tiny).collect(), docs, lambda n: best_fit(n, CAPACITY))
