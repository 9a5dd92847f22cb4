"""Best-fit packing of token sequences, planned over the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens.  The plan is made from the counts of the lengths (at most
``capacity`` numbers, whatever the corpus holds): lengths in falling order, each put into the open sequences with the
tightest room.  Sequences that are filled alike are one class with a contiguous range of numbers, so a plan line says
"pieces number r to r+n of length L go to sequences s to s+n at offset o".  Pieces take their slots by joining on their
rank within their length.  Each task numbers its own pieces of each length while it cuts them; the numbers are shifted
by what tasks before it hold, so no length, however common, is sorted or counted in one task.  The join is on (length,
block of ``RANKS`` ranks), so no task meets more pieces than a block has, however many share a length.

Defined cases: a null or empty text is one piece of length 1 (the closing id 0); equal rows get different slots; a
null doc_id is kept as null; empty tables give no rows; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.llm.tokens import default_path, described, encoder
from loomwright.session import materialize, table

CAPACITY = 2048
#: Ranks that are joined with their slots by one key, and blocks that one row of the plan goes over at most.
RANKS, LONGEST = 4096, 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, own_rank long"


def cut(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text) with the checksum of their ids, the task that cut them and their
    rank among its pieces of their length."""
    shared = spark.sparkContext.broadcast(described(path))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, width = encoder(*shared.value).ids, 4 * capacity
        part, held = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                packed = ids(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(packed), width)):
                    own = packed[at : at + width]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), part, held[n]))
                    held[n] += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(pieces, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: lines (length, first rank, pieces, first sequence, offset)."""
    lines: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, sequences)
    order: list[int] = []  # the rooms that have ranges, rising
    made = 0

    def open_room(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                bisect.insort(order, room)
                rooms[room] = []
            rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                # one piece opens a sequence and those after it fill that one first: full columns, then one shorter
                per = capacity // length
                full, rest = divmod(left, per)
                for n, deep in ((full, per), (1, rest)):
                    if n and deep:
                        for k in range(deep):
                            lines.append((length, rank, n, made, k * length))
                            rank += n
                        open_room(capacity - deep * length, made, n)
                        made += n
                left = 0
                continue
            room = order[at]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            used = min(n, left)
            lines.append((length, rank, used, first, capacity - room))
            open_room(room - length, first, used)
            open_room(room, first + used, n - used)
            rank, left = rank + used, left - used
    return lines


def slots(spark: SparkSession, lines: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The plan as rows (p_length, p_block, first_rank, n, first_sequence, offset), once for each block of ranks that a
    line goes over; lines of very many pieces are cut first, so that no row is exploded into more than ``LONGEST``."""
    most = RANKS * LONGEST
    short = [(length, rank + at, min(most, n - at), first + at, offset) for length, rank, n, first, offset in lines for at in range(0, n, most)]
    rows = spark.createDataFrame(short, "p_length long, first_rank long, n long, first_sequence long, offset long")
    block = F.sequence(F.floor(F.col("first_rank") / RANKS), F.floor((F.col("first_rank") + F.col("n") - 1) / RANKS))
    return rows.withColumn("p_block", F.explode(block))


def pack(spark: SparkSession, docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` with the sequence and the offset that each takes."""
    pieces = materialize(spark, cut(spark, docs, path, capacity))
    held = materialize(spark, pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    shift = held.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rank = F.col("shift") + F.col("own_rank")
    ranked = pieces.join(shift, ["length", "part"]).withColumn("rank", rank).withColumn("block", F.floor(rank / RANKS))
    inside = (F.col("length") == F.col("p_length")) & (F.col("block") == F.col("p_block")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    placed = ranked.join(slots(spark, plan(counts, capacity)), inside)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
