"""Near-duplicate documents by MinHash with odd sketches.

A document's set holds its distinct shingles of five words.  Equal sets are one class, and only the class's smallest
document goes on.  ``SAMPLES`` MinHash samples give ``bands()`` keys of ``ROWS`` samples; all samples are also folded
into a parity bitmap (an odd sketch), and the population count of the XOR of two bitmaps estimates how many samples
differ, which at high similarity is far more precise for its bytes than the samples themselves.  Within a bucket only
pairs whose sketches could belong to linked sets count; they join documents into candidate clusters, and within a
cluster every such pair that isn't connected yet is confirmed on the full sets.

Skew: copies are folded before banding; buckets of more than ``BLOCK`` documents are dealt out as pairs of blocks, so a
task holds two blocks at most.  A cluster of more than ``BLOCK`` documents is first compared with its smallest one, in
parts that hold that one's text each; only documents that aren't linked with it (and so with each other) are then
compared among themselves and with the rest, as pairs of blocks.  Nothing is capped or dropped.  A pair that is linked is missed only if no
band agrees (under ``MISSED`` at the threshold, for which the number of bands is chosen) or its sketches differ by ``MARGIN`` standard errors more than they should.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; with fewer than five words
the whole sequence is its one shingle; rows with a null doc_id are linked with nothing, have a null component and are
kept; rows that share a doc_id are one node, each with its own set; repeated rows are copies; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.components import components
from loomwright.session import materialize, table

SHINGLE, ROWS, SAMPLES, BITS = 5, 4, 256, 512
#: Links: 100 * intersection >= percent * union; this is the percent of op1.
PERCENT = 85
#: Chance that no band of a pair at the threshold agrees.
MISSED = 1e-5
#: Standard errors of the estimate that a candidate may fall short by.
MARGIN = 4.0
#: Documents of a bucket or cluster that are dealt to one task together.
BLOCK = 512
#: Bytes of a clustered document without its text, and bytes up to which these are broadcast to the texts; more are joined
#: by a shuffle.
MEMBER_BYTES, BROADCAST_BYTES = 128, 32_000_000
_RNG = np.random.RandomState(20240229)
_A = (_RNG.randint(0, 1 << 31, SAMPLES).astype("u4") << np.uint32(1)) | np.uint32(1)
_B = _RNG.randint(0, 1 << 32, SAMPLES, dtype="u8").astype("u4")
_TURN = np.arange(1, SAMPLES + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A full avalanche of 64-bit values."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    if len(h) < SHINGLE:
        h = np.append(h, np.zeros(SHINGLE - len(h), "u8") + np.uint64(len(words)))
    n = len(h) - SHINGLE + 1
    out = np.zeros(n, "u8")
    for k in range(SHINGLE):
        out = mix(out ^ h[k : k + n] * _POWERS[k])
    return np.unique(out)


def samples(own: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set."""
    x = (own >> np.uint64(32)).astype("u4")
    least = np.full(SAMPLES, 0xFFFFFFFF, "u4")
    for at in range(0, len(x), 1024):
        part = np.multiply.outer(_A, x[at : at + 1024])
        part += _B[:, None]
        np.minimum(least, part.min(1), out=least)
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """The odd sketch: each sample flips one bit."""
    bit = (mix(least.astype("u8") + _TURN) % np.uint64(BITS)).astype("i8")
    odd = np.bincount(bit, minlength=BITS) & 1
    return np.packbits(odd.astype("u1")).view("u8")


def bands(percent: int = PERCENT) -> int:
    """Bands that miss a pair at the threshold with a chance of ``MISSED`` at most: 16 at 85, 22 at 80."""
    n = math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS))) if percent < 100 else 1
    if not 0 < n <= SAMPLES // ROWS:
        raise ValueError(f"{SAMPLES} samples are too few for a threshold of {percent} percent")
    return n


def band_keys(least: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit key for each of ``n`` bands."""
    key = np.arange(1, n + 1, dtype="u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(ROWS):
        key = mix(key ^ least[k : n * ROWS : ROWS].astype("u8") * _POWERS[k])
    return key.view("i8")


SIGNED = "doc_id long, n_shingles long, class binary, bands array<long>, sketch binary"


def sign(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """n_shingles, the class (a digest of the whole set), band keys and odd sketch of each row."""
    n = bands(percent)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = shingles(text)
                if not len(own):
                    out.append((doc, 0, None, None, None))
                    continue
                least = samples(own)
                out.append((doc, len(own), xxhash.xxh128_digest(own.tobytes()), band_keys(least, n), sketch(least).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "class", "bands", "sketch"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, SIGNED)


def differing(percent: int = PERCENT) -> int:
    """Sketch bits that a pair at the threshold differs in, with the margin."""
    j = percent / 100
    j -= MARGIN * (j * (1 - j) / SAMPLES) ** 0.5
    return int(np.ceil(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - j) / BITS)) + MARGIN / 2 * (2 * SAMPLES * (1 - j)) ** 0.5 / 2))


class Forest:
    """Union-find over ids; the smaller id is the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def links(self) -> pd.DataFrame:
        found = [(x, self.root(x)) for x in self.up]
        return pd.DataFrame([(a, b) for a, b in found if a != b], columns=["a", "b"]).astype("int64")


def in_groups(handle: Callable[[pd.DataFrame, Forest], None], group: list[str]):
    """A mapInPandas function over rows that are sorted by ``group``: each group goes to ``handle`` whole; what the
    forest has joined comes out as links to the roots, again and again so that it stays bounded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, kept = Forest(), []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[group].to_numpy()
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1)
            if kept and (kept[-1][group].iloc[-1].to_numpy() == keys[0]).all():
                if len(starts) == 1:
                    kept.append(batch)
                    continue
                kept.append(batch.iloc[: starts[1]])
                handle(pd.concat(kept), forest)
                batch, starts = batch.iloc[starts[1] :], starts[1:] - starts[1]
            elif kept:
                handle(pd.concat(kept), forest)
            if starts[-1]:
                handle(batch.iloc[: starts[-1]], forest)
            kept = [batch.iloc[starts[-1] :]]
            if len(forest.up) > 300_000:
                yield forest.links()
                forest = Forest()
        if kept:
            handle(pd.concat(kept), forest)
        yield forest.links()

    return run


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches row by row."""
    return np.bitwise_count(a ^ b).sum(-1, dtype="i8")


def bucket_links(batch: pd.DataFrame, forest: Forest, percent: int = PERCENT) -> None:
    """Joins the documents of each bucket in ``batch`` (several whole buckets, sorted) whose sketches are close enough.
    All pairs at a distance of d rows are compared at once."""
    ids, side = batch["doc_id"].to_numpy(), batch["side"].to_numpy()
    bucket, i, j = (batch[c].to_numpy() for c in ("bucket", "i", "j"))
    sketches = np.frombuffer(b"".join(batch["sketch"]), "u8").reshape(len(batch), -1)
    limit, d = differing(percent), 1
    left = np.arange(len(ids) - 1)
    while len(left):
        left = left[left + d < len(ids)]
        right = left + d
        same = (bucket[left] == bucket[right]) & (i[left] == i[right]) & (j[left] == j[right])
        left, right = left[same], right[same]
        new = (i[left] == j[left]) | (side[left] != side[right])
        close = likely(sketches[left], sketches[right]) <= limit
        for a, b in zip(ids[left[new & close]].tolist(), ids[right[new & close]].tolist(), strict=True):
            forest.join(a, b)
        d += 1


def confirm(batch: pd.DataFrame, forest: Forest, percent: int = PERCENT) -> None:
    """Joins the documents of each cluster block in ``batch`` that are linked by their full sets.  Sets are made from
    the texts when a pair needs them: most documents of a dense cluster are joined after one or two comparisons."""
    limit = differing(percent)
    for _, part in batch.groupby(["cluster", "i", "j"], sort=False):
        ids, side, texts = part["doc_id"].tolist(), part["side"].to_numpy(), part["text"].tolist()
        sets: dict[int, np.ndarray] = {}
        drawn, sizes = part["sketch"].tolist(), part["n_shingles"].tolist()
        for x in (x for x, s in enumerate(drawn) if s is None):
            sets[x] = shingles(texts[x])
            drawn[x], sizes[x] = sketch(samples(sets[x])).tobytes(), len(sets[x])
        sizes, sketches = np.array(sizes, "i8"), np.frombuffer(b"".join(drawn), "u8").reshape(len(part), -1)
        crossing = part["i"].iloc[0] != part["j"].iloc[0]
        pairs = []
        for k in range(len(ids) - 1):
            near = np.bitwise_count(sketches[k + 1 :] ^ sketches[k]).sum(-1, dtype="i8")
            low, high = np.minimum(sizes[k + 1 :], sizes[k]), np.maximum(sizes[k + 1 :], sizes[k])
            fit = (near <= limit) & (100 * low >= percent * high)
            if crossing:
                fit &= side[k + 1 :] != side[k]
            pairs += [(int(near[x]), k, k + 1 + int(x)) for x in np.flatnonzero(fit)]
        for _, a, b in sorted(pairs):
            if forest.root(ids[a]) != forest.root(ids[b]):
                for x in (a, b):
                    if x not in sets:
                        sets[x] = shingles(texts[x])
                if linked(sets[a], sets[b], percent):
                    forest.join(ids[a], ids[b])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def dealt(rows: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` once for each pair of blocks (i <= j) of their group that they belong to; ``counts`` has each group's
    ``n``.  A group of up to BLOCK rows is the pair (0, 0)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rows.join(counts, key).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit("block")), blocks).cast("int")).withColumn("blocks", blocks)
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", F.col("own") == F.col("i")).drop("n", "blocks", "own", "other")


def stars(members: DataFrame) -> DataFrame:
    """Members of large clusters in parts of about ``BLOCK``, each beside the cluster's smallest document."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    others = members.where("doc_id <> cluster").withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit("star")), parts).cast("int")).withColumn("side", F.lit(False))
    firsts = members.where("doc_id = cluster").withColumn("i", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("side", F.lit(True))
    return others.unionByName(firsts).withColumn("j", F.lit(-1))


def crossed(apart: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs of blocks: documents of ``apart`` among themselves, and beside those of ``joined`` in their cluster."""
    mine, theirs = (x.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)) for x, name in ((apart, "mine"), (joined, "theirs")))
    counts = apart.groupBy("cluster").agg(F.count("*").alias("n"))
    among = dealt(apart, "cluster", counts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("doc_id", F.lit("cross")), F.col(n)).cast("int")
    a = apart.join(mine, "cluster").join(theirs, "cluster").withColumn("i", block("mine")).withColumn("j", every("theirs")).withColumn("side", F.lit(True))
    b = joined.join(mine, "cluster").join(theirs, "cluster").withColumn("j", block("theirs")).withColumn("i", every("mine")).withColumn("side", F.lit(False))
    return among.unionByName(a.unionByName(b).withColumn("j", -1 - F.col("j")).drop("mine", "theirs"))


def confirm_links(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the blocks in ``members`` (cluster, i, j, side, doc_id, n_shingles, sketch), by the full sets."""
    members = materialize(docs.sparkSession, members)
    sized = F.broadcast if members.count() * MEMBER_BYTES <= BROADCAST_BYTES else (lambda x: x)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(members), "doc_id")
    group = ["cluster", "i", "j"]
    return texts.select(*group, "side", "doc_id", "n_shingles", "sketch", "text").repartition(*group).sortWithinPartitions(*group).mapInPandas(in_groups(partial(confirm, percent=percent), group), "a long, b long")


def near_links(spark: SparkSession, docs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the class representatives that are linked with another class."""
    first = signed.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    firsts = materialize(spark, signed.where("class is not null").join(first, ["class", "doc_id"], "left_semi").select("doc_id", "class", "n_shingles", "bands", "sketch").dropDuplicates(["class"]))
    banded = firsts.select("doc_id", F.posexplode("bands").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("bucket"))
    counts = materialize(spark, banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = materialize(spark, dealt(banded, "bucket", counts))
    buckets = shared.join(firsts.select("doc_id", "sketch"), "doc_id").select("bucket", "i", "j", "side", "doc_id", "sketch")
    group = ["bucket", "i", "j"]
    candidates = buckets.repartition(*group).sortWithinPartitions(*group).mapInPandas(in_groups(partial(bucket_links, percent=percent), group), "a long, b long")
    clusters = materialize(spark, components(spark, candidates).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")))
    sizes = materialize(spark, clusters.groupBy("cluster").agg(F.count("*").alias("n")))
    # a doc_id with several texts has no one sketch: theirs are made again from the texts
    one = F.count("*") == 1
    drawn = firsts.groupBy("doc_id").agg(F.when(one, F.first("sketch")).alias("sketch"), F.when(one, F.first("n_shingles")).alias("n_shingles"))
    members = materialize(spark, clusters.join(drawn, "doc_id").join(sizes, "cluster"))
    small = members.where(F.col("n") <= BLOCK).withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).withColumn("side", F.lit(True))
    confirmed = materialize(spark, confirm_links(docs, small.unionByName(stars(members.where(F.col("n") > BLOCK))).drop("n"), percent))
    large = members.where(F.col("n") > BLOCK).drop("n")
    if not large.isEmpty():
        # links go to the smallest document that a task has joined, which in these parts is the cluster's own
        joined = materialize(spark, large.join(confirmed, (large["cluster"] == confirmed["b"]) & (large["doc_id"] == confirmed["a"]), "left_semi"))
        apart = materialize(spark, large.where("doc_id <> cluster").join(joined.select("doc_id"), "doc_id", "left_anti"))
        confirmed = confirmed.unionByName(confirm_links(docs, crossed(apart, joined), percent))
    # an id with several texts joins the classes of all of them
    rows = signed.where("class is not null and doc_id is not null").select("doc_id", "class")
    several = rows.groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("doc_id")
    shared = rows.join(several, "doc_id", "left_semi").join(first.withColumnRenamed("doc_id", "b"), "class").select(F.col("doc_id").alias("a"), "b")
    return components(spark, confirmed.unionByName(shared))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text); sets that are similar by
    ``percent`` or more are linked."""
    signed = materialize(spark, sign(docs, percent))
    roots = near_links(spark, docs, signed, percent)
    first = signed.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("node"))
    classes = materialize(spark, first.join(roots, "node", "left").select("class", F.coalesce("root", "node").alias("component_id")))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    alone = rows.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = rows.where("class is not null").join(classes, "class").select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_minhash_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), PERCENT)


#: The same over DuckDB, from all pairs that share a shingle.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' ')) END) AS x FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n_both FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS (SELECT DISTINCT da.doc_id AS a, db.doc_id AS b FROM p JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b JOIN d da ON da.r = p.a JOIN d db ON db.r = p.b
  WHERE 100 * n_both >= {PERCENT} * (na.n + nb.n - n_both) AND da.doc_id <> db.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS id, a AS other FROM e UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.other),
m AS (SELECT id, min(other) AS root FROM c GROUP BY id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN doc_id ELSE coalesce(root, doc_id) END AS component_id,
  doc_id IS NOT DISTINCT FROM (CASE WHEN n.n IS NULL THEN doc_id ELSE coalesce(root, doc_id) END) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN m ON m.id = d.doc_id
"""
