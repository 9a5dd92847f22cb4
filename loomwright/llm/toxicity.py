"""Toxicity by multiple-instance learning: documents are bags of sentences, labels belong to documents only.

Each sentence has a logistic score from its distinct words (whole words and their prefixes are the features); a
document's score is the noisy-or of its sentences, 1 - prod(1 - p).  Training maximises the likelihood of the document
labels through the noisy-or, so the model finds by itself which sentences are to blame, and can point at them.

Fitting uses a documented, bounded sample (``SAMPLE`` labelled documents of ``SAMPLE_BYTES`` together, ``FEATURES``
features); scoring covers whole texts of all documents.

Defined cases: null and empty texts, and texts without a word, score 0; without any usable label all scores are 0;
repeated labels of one document count as toxic if one of them is; of several texts of one doc_id the smallest is learned
from; a document that would take the sample over its bytes isn't learned from; rows with a null doc_id are never learned from and
are marked as held out; a sentence ends at . ! ? or a newline, and has no length limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.sampling import remainder, smallest_hashes
from loomwright.session import materialize, table

#: Labelled documents to fit on, features kept, least toxic documents that a feature is in.
SAMPLE, FEATURES, LEAST = 8000, 2000, 3
#: UTF-8 bytes of the texts that are fitted on; what comes to the driver is at most as large.
SAMPLE_BYTES = 64_000_000
#: Word prefixes that are features beside the whole word.
PREFIXES = (3, 4, 5, 6, 7)
#: Documents that are held out: this remainder of crc32(doc_id) modulo FOLDS.
FOLDS, HELD_OUT = 5, 0
#: POSITIVE: weight of a toxic document beside one that isn't.
ROUNDS, RATE, DECAY, POSITIVE = 250, 0.06, 1e-4, 3.0
#: Words that a task keeps the weights of.
CACHE_ENTRIES = 100_000
WORDS = re.compile(r"[^\W\d_]+").findall
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) > k)]


def sentences(text: str | None) -> list[set[str]]:
    return [s for s in (set(WORDS(x)) for x in SENTENCE.findall((text or "").lower())) if s]


class Model:
    """Feature weights and a bias; ``of`` scores one sentence's words, words are summed up once and kept."""

    def __init__(self, weights: dict[str, float], bias: float | None):
        self.bias = bias

        class Words(dict):
            def __missing__(self, word):
                if len(self) > CACHE_ENTRIES:
                    self.clear()
                out = self[word] = sum(weights.get(f, 0.0) for f in features(word))
                return out

        self.words = Words()

    def scores(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence that has a word."""
        if not text or self.bias is None:
            return []
        low, out, weight = text.lower(), [], self.words.__getitem__
        if len(low) != len(text):  # a lower case of another length would shift the spans
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in SENTENCE.finditer(low):
            words = set(WORDS(m[0]))
            if words:
                z = self.bias + sum(map(weight, words))
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-z)) if z > -700 else 0.0))
        return out


def noisy_or(scores: list[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum())) if scores else 0.0


def packed(bag: list[list[int]]) -> tuple[bytes, bytes]:
    """A bag as (features of each sentence that has any, in one run; their numbers), little-endian."""
    full = [x for x in bag if x]
    return np.array([i for x in full for i in x], "<u2").tobytes(), np.array([len(bag) - len(full), *map(len, full)], "<u4").tobytes()


def train(bags: list[tuple[bytes, bytes]], labels: list[int], n: int) -> tuple[np.ndarray, float]:
    """Weights and bias from bags as :func:`packed` has them, by Adam on the noisy-or likelihood."""
    y = np.array(labels, "f8")
    sizes = [np.frombuffer(b, "<u4") for _, b in bags]
    bare = np.array([x[0] for x in sizes], "f8")  # sentences without a feature: all alike
    words = np.frombuffer(b"".join(a for a, _ in bags), "<u2")
    row = np.repeat(np.arange(sum(len(x) - 1 for x in sizes), dtype="i4"), np.concatenate([x[1:] for x in sizes]))
    doc = np.repeat(np.arange(len(bags), dtype="i4"), [len(x) - 1 for x in sizes])
    w, b = np.zeros(n), -4.0
    moments = [np.zeros(n + 1), np.zeros(n + 1)]
    for k in range(1, ROUNDS + 1):
        z = np.bincount(row, w[words], len(doc)) + b
        p, lone = (1 / (1 + np.exp(-np.clip(x, -50, 50))) for x in (z, b))
        q = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + bare * np.log1p(-min(lone, 1 - 1e-12)))
        pull = np.where(y == 1, -POSITIVE * q / np.maximum(1 - q, 1e-9), 1.0)
        g = p * pull[doc]
        grad = np.append(np.bincount(words, g[row], n) / len(y) + DECAY * w, (g.sum() + lone * (bare * pull).sum()) / len(y))
        moments = [0.9 * moments[0] + 0.1 * grad, 0.99 * moments[1] + 0.01 * grad**2]
        step = RATE * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def within(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """The ids of (id, bytes) that are taken in this order while they fit."""
    out, held = [], 0
    for one, n in sizes:
        if held + n <= most:
            out.append(one)
            held += n
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], float | None]:
    """Weights by feature, and the bias (None: nothing to learn from)."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & (remainder(FOLDS) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = smallest_hashes(known, sample)  # at most ``sample`` rows of two numbers: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = materialize(spark, texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(max(2, spark.sparkContext.defaultParallelism), F.xxhash64("doc_id", "text")))
    sizes = rows.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()
    taken = within([(r.doc_id, r.n) for r in sorted(sizes, key=lambda r: (r.h, r.doc_id))], SAMPLE_BYTES)
    if len(taken) < len(sizes):
        rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in taken], "doc_id long")), "doc_id")

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                found = sorted({f for s in sentences(text) for w in s for f in features(w)})
                yield pd.DataFrame({"feature": found, "toxic": y})

    total = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in total}
    if not n.get(1) or not n.get(0):
        return {}, None
    counts = rows.select("text", "toxic").mapInPandas(held, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = (F.col("a") + F.col("b")) / (n[0] + n[1])
    z = F.abs(F.col("a") / n[1] - F.col("b") / n[0]) / F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    kept = counts.where(F.col("a") >= min(LEAST, n[1])).orderBy(z.desc(), "feature").limit(FEATURES).select("feature").collect()
    number = {r.feature: i for i, r in enumerate(kept)}

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                bag = [[number[f] for w in sorted(s) for f in features(w) if f in number] for s in sentences(text)]
                out.append(packed(bag or [[]]))  # sentences without a feature count too, as they do in a score
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "words": [x for x, _ in out], "sizes": [x for _, x in out]})

    # a word of three letters or more gives two bytes for each feature it has, so this is bounded as the texts are
    told = sorted((r.doc_id, r.toxic, bytes(r.words), bytes(r.sizes)) for r in rows.mapInPandas(bags, "doc_id long, toxic int, words binary, sizes binary").toLocalIterator())
    w, bias = train([r[2:] for r in told], [r[1] for r in told], len(number))
    return {f: round(float(w[i]), 6) for f, i in number.items() if abs(w[i]) > 1e-6}, round(bias, 6)


SCORED = "score double, n_offending int, worst_start int, worst_length int, worst_score double"


def scorer(spark: SparkSession, weights: dict[str, float], bias: float | None):
    """A column function: a text's score and its worst sentence (the first of the highest)."""
    shared = spark.sparkContext.broadcast((weights, bias))  # FEATURES entries at most

    @F.pandas_udf(SCORED)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)  # and its words, for this task alone: workers are used again by later stages
        for texts in batches:
            out = []
            for text in texts:
                found = model.scores(text)
                if not found:
                    out.append((0.0, 0, None, None, None))
                    continue
                worst = max(found, key=lambda x: (x[2], -x[0]))
                out.append((round(noisy_or([x[2] for x in found]), 9), sum(x[2] >= 0.5 for x in found), worst[0], worst[1] - worst[0], worst[2]))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCORED.split(", ")])
            yield frame.astype({"n_offending": "int32", "worst_start": "Int32", "worst_length": "Int32", "worst_score": "float64"})

    return scored


def locate(docs: DataFrame, weights: dict[str, float], bias: float | None, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, score, sentence of each offending sentence."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for batch in batches:
            rows = [(d, a, b, p, t[a:b]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for a, b, p in model.scores(t) if p >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "score", "sentence"]).astype({"doc_id": "Int64", "start": "int32", "end": "int32", "score": "float64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(found, "doc_id long, start int, end int, score double, sentence string")


def score(docs: DataFrame, weights: dict[str, float], bias: float | None) -> DataFrame:
    s = docs.select("doc_id", scorer(docs.sparkSession, weights, bias)("text").alias("s"))
    held = F.coalesce(remainder(FOLDS) == HELD_OUT, F.lit(True))
    return s.select("doc_id", held.alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.n_offending", "s.worst_start", "s.worst_length", "s.worst_score")


def op7_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
