"""Texts aren't shuffled to be held against small tables."""

import corpus_pipeline
from loomwright.llm import mixing


def moved(df):
    """Whether the final plan of ``df`` shuffles anything."""
    df.collect()
    return "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_mixing_and_the_end_of_near_duplicates_leave_texts_where_they_are(spark, tiny):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")  # sizes are guessed; these tables are counted
    try:
        docs = spark.read.parquet(f"{tiny}/documents.parquet")
        assert not moved(mixing.mixed(spark, docs))
        assert not moved(corpus_pipeline.drop_near_duplicates(spark, docs, tiny))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
