"""Language identification by nearest centroid: normalised TF-IDF vectors of letter n-grams against several clustered
centroids for each language, by cosine, with rejection by distance.

Letters are lower-cased and everything else becomes one separator; n-grams of 2 and 3 are hashed into ``WIDTH``
buckets.  Spherical k-means gives each language up to ``CENTROIDS`` centroids.

A text is rejected if its cosine to the nearest centroid is under the ``LOW`` quantile of the cosines that texts of its
length (by powers of two of the letters) have to their own language, as any text's cosine rises with its length.  Those
are measured on windows of all lengths, cut from documents that the measuring centroids weren't fitted on (the sample
is halved, each half is measured against the other's), so short texts have as many as long ones.  Lengths that too few
windows have are measured together with shorter ones; without any window nothing is too far.

Fitting uses a bounded sample (``SAMPLE`` documents with a language); whole texts of all documents are classified.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if there
is nothing to learn from; ties go to the language that sorts first; rows with a null doc_id are never learned from and
are marked as held out; a null language is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.sampling import remainder, smallest_hashes
from loomwright.session import materialize, table

WIDTH, CENTROIDS, SAMPLE, STEPS = 4096, 4, 4000, 12
#: Quantile of own-language cosines that is too low.
LOW = 0.005
FOLDS, HELD_OUT = 3, 1
#: What a cosine may differ by where it is computed again.
ROUNDING = 1e-4
#: Characters that are hashed at a time.
SLICE = 2_000_000
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Each code point's lower-case letter, or 0; made once for each worker."""
    if not _LETTERS:
        found = np.zeros(0x110000, "u4")
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                found[i] = ord(low) if len(low) == 1 else i
        _LETTERS.append(found)
    return _LETTERS[0]


def histogram(text: str) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams of a text, and its number of letters."""
    counts, n = np.zeros(WIDTH, "f4"), 0
    for at in range(0, len(text), SLICE):
        code = letters()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")]
        full = code != 0
        n += int(full.sum())
        kept = code[full | np.append(True, full[:-1])]  # one separator between words
        kept = np.concatenate(([0], kept, [0])).astype("u4")
        two = kept[:-1] * np.uint32(0x9E3779B1) ^ kept[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ kept[2:] * np.uint32(0x27D4EB2F)
        for h in (two, three):
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(20), minlength=WIDTH).astype("f4")
    return counts, n


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf, at length 1."""
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]  # of each centroid
    floors: np.ndarray  # cosine that is too low, by power of two of the letters

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for text in texts:
            counts, n = histogram(text) if text else (None, 0)
            if not n or not self.names:
                out.append(("und", 0.0, True))
                continue
            near = self.centroids @ weigh(counts, self.idf)
            best = int(np.argmax(near))
            score = float(min(1.0, max(0.0, near[best])))
            out.append((self.names[best], round(score, 9), bool(score < self.floors[min(n.bit_length(), 40)])))
        return out


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means with the first centroid at the mean and each next one at the farthest row."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.array(centres).T / np.linalg.norm(centres, axis=1), axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(STEPS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def windows(text: str) -> Iterator[str]:
    """The whole text, and parts from its middle of widths 2, 3, 6, 12, 24 and so on."""
    yield text
    width = 2
    while width < len(text):
        at = (len(text) - width) // 2
        yield text[at : at + width]
        width = 3 if width == 2 else width * 2


def own_cosines(model: Model, lang: str, text: str) -> Iterator[tuple[int, float]]:
    """(power of two of the letters, cosine to the nearest centroid of ``lang``) of each window with a letter."""
    own = model.centroids[[k for k, name in enumerate(model.names) if name == lang]]
    for part in windows(text) if len(own) else ():
        counts, n = histogram(part)
        if n:
            yield min(n.bit_length(), 40), float((own @ weigh(counts, model.idf)).max())


def limits(found: list[tuple[int, float]]) -> np.ndarray:
    """The floor of each power of two of the letters, ``ROUNDING`` under the quantile.  Lengths that too few windows have
    to tell the quantile are taken together with shorter ones, whose cosines are lower."""
    floors, by = np.zeros(41), {}
    for bits, cosine in found:
        by.setdefault(bits, []).append(cosine)
    for b in range(1, 41):
        pool: list[float] = []
        for a in range(b, 0, -1):
            pool += by.get(a, [])
            if len(pool) >= 1 / LOW:
                break
        floors[b] = np.quantile(pool, LOW, method="lower") - ROUNDING if pool else 0.0
    return floors


def centred(rows: list[tuple[str, int, bytes, bytes]]) -> Model:
    """Idf and centroids of (language, letters, buckets, counts), without floors."""
    if not rows:
        return Model(np.zeros(WIDTH), np.zeros((0, WIDTH)), [], np.zeros(41))
    x = np.zeros((len(rows), WIDTH), "f4")
    for i, (_, _, at, counts) in enumerate(rows):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(counts, "<f4")
    idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(0))) + 1).astype("f4")
    x = weigh(x, idf)
    langs = np.array([r[0] for r in rows])
    centroids, names = [], []
    for lang in sorted(set(langs)):
        own = cluster(x[langs == lang], CENTROIDS)
        centroids.append(own)
        names += [lang] * len(own)
    return Model(idf, np.concatenate(centroids).astype("f4"), names, np.zeros(41))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(FOLDS) != HELD_OUT)
    known = docs.select("doc_id", "lang", "text").where(usable)
    keys = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (remainder(FOLDS) != HELD_OUT))
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)).cast("int").alias("half")
    # spread over the cores, whatever the partitions of the corpus were
    chosen = materialize(spark, smallest_hashes(known, sample, keys).repartition(max(2, spark.sparkContext.defaultParallelism), F.xxhash64("doc_id", "text")).select("lang", "text", half))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, text, half in zip(batch["lang"], batch["text"], batch["half"], strict=True):
                counts, n = histogram(text)
                at = np.flatnonzero(counts)
                rows.append((lang, n, at.astype("<u2").tobytes(), counts[at].astype("<f4").tobytes(), half))
            yield pd.DataFrame(rows, columns=["lang", "n", "at", "counts", "half"])

    found = chosen.mapInPandas(counted, "lang string, n long, at binary, counts binary, half int").where("n > 0").toLocalIterator()
    rows = sorted((r.lang, r.n, bytes(r["at"]), bytes(r["counts"]), r.half) for r in found)
    model = centred([r[:4] for r in rows])
    if not rows:
        return model
    halves = spark.sparkContext.broadcast([centred([r[:4] for r in rows if r[4] != half]) for half in (0, 1)])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [x for lang, text, half in zip(batch["lang"], batch["text"], batch["half"], strict=True) for x in own_cosines(halves.value[half], lang, text)]
            yield pd.DataFrame(out, columns=["bits", "cosine"]).astype({"bits": "int32", "cosine": "float64"})

    # as many numbers as the sample has documents, for each power of two
    model.floors = limits([(r.bits, r.cosine) for r in chosen.mapInPandas(measured, "bits int, cosine double").toLocalIterator()])
    return model


FOUND = "lang_pred string, score double, rejected boolean"


def classifier(spark: SparkSession, model: Model):
    """A column function: a text's language, cosine and whether it is rejected."""
    shared = spark.sparkContext.broadcast(model)  # languages x CENTROIDS x WIDTH numbers

    @F.pandas_udf(FOUND)
    def classified(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.classify(list(texts)), columns=[c.split()[0] for c in FOUND.split(", ")])

    return classified


def identify(docs: DataFrame, model: Model) -> DataFrame:
    held = F.coalesce(remainder(FOLDS) == HELD_OUT, F.lit(True))
    return docs.select("doc_id", held.alias("held_out"), classifier(docs.sparkSession, model)("text").alias("f")).select("doc_id", "held_out", "f.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
