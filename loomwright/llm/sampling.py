"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, n: int, keys: DataFrame | None = None) -> DataFrame:
    """One row for each of the ``n`` doc_ids (all, if there are fewer) with the smallest hashes.

    The cut is found from ``keys`` (doc_id; by default those of ``df``), so no text is read for it.  Hashes are even,
    so all but about 2n doc_ids are filtered where they are read, and little is shuffled at any size.  Of rows that
    share a doc_id the smallest is taken, so a sample is repeatable."""
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    keys = (df if keys is None else keys).select(hashed.alias("h"))
    ids = keys.agg(F.approx_count_distinct("h")).first()[0]
    near = keys.where(F.col("h") <= F.lit(int(-(2**63) + 2**64 * (2 * n / ids)))) if ids > 4 * n else keys
    found = near.distinct().orderBy("h").limit(n).agg(F.max("h"), F.count("h")).first()
    if ids > 4 * n and found[1] < n:  # fewer than were counted on
        found = keys.distinct().orderBy("h").limit(n).agg(F.max("h"), F.count("h")).first()
    chosen = df.where(hashed <= F.lit(found[0])) if found[1] else df.limit(0)
    others = [c for c in df.columns if c != "doc_id"]
    least = chosen.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")) if others else chosen.distinct()
    return (least.select("doc_id", "row.*") if others else least).limit(n).select(*df.columns)


def remainder(n: int):
    """crc32 of doc_id as text, modulo ``n``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))
