from pyspark.sql import functions as F

from loomwright.llm.sampling import smallest_hashes


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = ({r.doc_id for r in smallest_hashes(df.repartition(k), 100).collect()} for k in (1, 7))
    want = {r.doc_id for r in df.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(100).collect()}
    assert a == b == want
    assert smallest_hashes(df.limit(30), 100).count() == 30 and smallest_hashes(df.limit(0), 100).count() == 0


def test_one_hot_id_is_one_row(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"))
    rows = [r.doc_id for r in smallest_hashes(df, 200).collect()]
    assert len(rows) == len(set(rows)) and len(rows) <= 200
    hot = spark.range(3000).select(F.lit(5).alias("doc_id"))
    assert smallest_hashes(hot, 200).count() == 1
