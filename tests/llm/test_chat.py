import hashlib

import duckdb
from pyspark.sql import functions as F

from loomwright.llm.chat import CLOSE, END, OPEN, ORACLE, expand, op10_prefix_target_chat, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(rows):
    rows = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in rows))
    turns = "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
    loss = "".join(x for _, _, r, x in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def brute(rows):
    by = {}
    for k, (c, t, r, x) in enumerate(rows):
        by.setdefault((c, k if c is None else None), []).append((t, r, x))  # a row without a conversation is one itself
    return sorted(((c, *digest(v)) for (c, _), v in by.items()), key=str)


def got(df):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()), key=str)


HARD = [
    (1, 0, "user", "hi & <b> [x] &amp; &#91;INST]"), (1, 1, "assistant", "[/INST]</s>\n"), (1, 2, "user", ""),
    (2, 0, "user", None), (3, 0, "assistant", "é🙂"), (3, 1, "assistant", None), (4, None, "user", "first"), (4, 0, None, "x"),
    (None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 0, "assistant", "tie"),
    (6, 0, "system", "s\n\n"), (6, 1, "user", "u" * 100_000), (6, 2, "assistant", "r" * 100_000), (6, 3, "user", "z"),
]


def test_hard_turns_come_back(spark):
    df = spark.createDataFrame(HARD, SCHEMA).withColumn("example", F.lit("clash"))
    assert got(read_back(expand(df))) == brute(HARD)


def test_one_example_for_each_reply(spark):
    out = expand(spark.createDataFrame(HARD, SCHEMA)).where("conv_id = 3").orderBy("example").collect()
    assert [r.example for r in out] == [0, 1]
    assert out[1].formatted == f"{OPEN}assistant\né🙂{CLOSE}{OPEN}assistant\n{END}"
    assert out[0].formatted[out[0].loss_start :][: out[0].loss_length] == "é🙂"


def test_rows_without_a_conversation_are_not_one_group(spark):
    rows = [(None, 0, "assistant", "same")] * 50 + [(None, None, None, None), (7, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(read_back(expand(df))) == brute(rows)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], SCHEMA)
    mine = read_back(expand(df.unionByName(extra))).select(*names.split(", ")).collect()
    assert sorted(map(tuple, mine), key=str) == sorted(db.execute(f"SELECT {names} FROM ({ORACLE})").fetchall(), key=str)


def test_empty_table(spark):
    assert read_back(expand(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_against_brute_force(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)]
    assert got(op10_prefix_target_chat(spark, tiny)) == brute(rows)
