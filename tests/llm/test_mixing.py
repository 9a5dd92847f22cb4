import random

import duckdb
from pyspark.sql import functions as F

from loomwright.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, topic int, rate string"


def oracle(rows):
    import pandas as pd

    db = duckdb.connect()
    documents = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    db.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source FROM documents")
    return sorted(db.execute(mixing.ORACLE).fetchall(), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n=600):
    langs = ["en", "de", "fr", None]
    return [(k, ["plain words ", "a license text ", "mail me @ home ", "see http now "][k % 4] * (1 + k % 9), langs[(k * k) % 4], f"s{k % 3}" if k % 3 else "hot", 1, "x") for k in range(n)]


def test_hard_rows_against_sql(spark):
    rows = corpus() + [(910, "in no language", "und", "", 1, "x"), (911, "in an empty one", "", None, 1, "x"), (912, "in null", None, "", 1, "x"), (900, None, None, None, 1, "x"), (901, "", "xx", "only empty", 1, "x"), (None, "no id", "en", "s1", 1, "x"), (5, "five again", "de", "s1", 1, "x"), (5, "five again", "de", "s1", 1, "x"), (902, "word " * 200_000, "fr", "s2", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(mixing.sample(spark, df)) == oracle(rows)
    kept = {tuple(r) for r in mixing.mixed(spark, df).collect()}
    chosen = {r.doc_id for r in mixing.sample(spark, df).where("sampled").collect()}
    assert {r[0] for r in kept} == chosen and kept <= set(rows)


def test_null_is_a_class_of_its_own(spark):
    rows = [(k, "some words", [None, "", "und"][k % 3], [None, ""][k % 2], 1, "x") for k in range(12)]
    cells = {(r.source, r.lang) for r in mixing.sample(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(cells) == 6


def cells_of(df):
    told = mixing.with_topics(df.select("doc_id", *[c.alias(n) for n, c in mixing.counts(df).items()]))
    return told.groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens"))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 7))) for _ in range(n))


def test_marginals_meet_the_targets(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, rng.randrange(1, 30)), rng.choice("abc"), rng.choice("stuv"), 1, "x") for k in range(600)]
    cells = cells_of(spark.createDataFrame(rows, SCHEMA))
    raked, residual = mixing.rake(spark, cells)
    assert residual <= mixing.TOLERANCE and raked.select("topic").distinct().count() == 2 ** len(mixing.PLANES)
    total = cells.agg(F.sum("tokens")).first()[0]
    for dim, power in mixing.TARGETS.items():
        both = raked.groupBy(dim).agg(F.sum("weight").alias("weight")).join(mixing.targets(cells, dim, power, total), F.col(dim) == F.col("t_value")).collect()
        assert both and all(abs(r.weight - r.target) < 1e-6 * r.target for r in both)
    assert mixing.rake(spark, cells, sweeps=1)[1] > residual


def test_given_targets(spark):
    rng = random.Random(5)
    rows = [(k, words(rng, 20), rng.choice("abc"), rng.choice(["s", "t", None]), 1, "x") for k in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    given = {"source": {"s": 0.7, None: 0.2, "nowhere": 0.05}, "lang": {"a": 0.0}}
    raked, residual = mixing.rake(spark, cells_of(df), given=given)
    total = raked.agg(F.sum("weight")).first()[0]
    share = {r.source: r.w / total for r in raked.groupBy("source").agg(F.sum("weight").alias("w")).collect()}
    assert residual <= mixing.TOLERANCE and abs(share["s"] / share[None] - 3.5) < 1e-6 and abs(share["t"] - 0.05 / 0.95) < 1e-6
    assert raked.where("lang = 'a'").agg(F.sum("weight")).first()[0] == 0
    kept = mixing.mixed(spark, df, given, 0.3)
    n = {r.source: r["count"] for r in kept.groupBy("source").count().collect()}
    assert kept.where("lang = 'a'").count() == 0 and 150 < sum(n.values()) < 400 and n["s"] > n[None] > n.get("t", 0)


def test_many_languages(spark):
    """Languages that are no codes are only slower."""
    rows = [(k, "some words of text " * (1 + k % 3), f"l{k % 3000}", f"s{k % 2}", 1, "x") for k in range(6000)]
    out = mixing.sample(spark, spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 6000


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.sample(spark, df).count() == 0 and mixing.mixed(spark, df).count() == 0


def test_query_against_sql(spark, tiny):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    assert rows_of(mixing.op4_raked_mixture(spark, tiny)) == sorted(db.execute(mixing.ORACLE).fetchall(), key=str)
