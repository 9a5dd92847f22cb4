"""The corpus pipeline: toxicity, language, near-duplicates, mixing and packing, each stage on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import language, mixing, near, packing, toxicity
from loomwright.llm.tokens import default_path
from loomwright.session import materialize, sent, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is 0.5 or more go; null and empty texts stay."""
    scored = toxicity.scorer(spark, *toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(scored("text")["score"] < 0.5)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's centroid is near to, and those without a letter, go."""
    return docs.where(~language.classifier(spark, language.fit(docs))("text")["rejected"])


#: Percent of similarity from which the pipeline's texts are near-duplicates; op1 has its own.
NEAR_PERCENT = 80
#: Bytes of a doc_id in a broadcast table.
GONE_BYTES = 32


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays; rows without a doc_id stay.  Of rows that share a doc_id and a text one
    stays, the smallest; rows that share a doc_id and differ in text are no copies of each other and all stay."""
    found = near.near_duplicates(spark, docs, NEAR_PERCENT)
    gone = materialize(spark, found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    left = docs.join(sent(gone, GONE_BYTES), docs["doc_id"] == gone["_gone"], "left_anti")  # texts stay where they are
    repeated = materialize(spark, docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("_again")))
    if repeated.isEmpty():
        return left
    once = left.join(repeated, left["doc_id"] == repeated["_again"], "left_anti")
    rows = left.join(repeated, left["doc_id"] == repeated["_again"], "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = rows.groupBy(F.col("doc_id").alias("_id"), F.sha2("text", 256).alias("_digest")).agg(F.min(whole).alias("_row"))
    return once.unionByName(least.select("_row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics are weighted as the targets say."""
    return mixing.mixed(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.pack(spark, docs, default_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]
#: Models are trained and texts are tokenised on the way, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
