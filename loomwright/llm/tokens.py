"""Token counts and ids of whole texts, equal to the tokenizers library's, mostly without it.

Pre-tokens are split once per text.  A pre-token that is known to encode alone as one token (proved offline against
the library, see :func:`whole_tokens`) is counted by a dictionary lookup; only the rest goes through the merges, and
the outcome is kept in a bounded cache.  That holds for texts in any script: which code points are letters, digits,
white space or others is asked of the library's own pre-tokenizer (:func:`kinds_of`), so no two Unicode tables have to
agree, and texts outside Latin-1 are normalised by the library's own normaliser.  Strings of special tokens are cut out
first, as the library does, and are one token each.

Defined cases: null and empty texts have 0 tokens; there is no length limit; repeated rows are counted each; columns
other than the key and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.session import table

#: The pre-token patterns of the two public vocabularies, over the kinds letter, number and space.
BYTE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
#: Code points that are asked about together.
RUN = 256

#: Entries that a worker keeps of merged pre-tokens.
CACHE_ENTRIES = 100_000
#: Production limit of the over_limit flag.
TOKEN_LIMIT = 1024


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character: itself, or the next free one from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    free = iter(range(256, 512))
    return {b: chr(b if b in own else next(free)) for b in sorted(range(256), key=lambda b: (b not in own, b))}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def checked(spec: dict) -> list[str]:
    """The strings of special tokens, longest first; a vocabulary whose options aren't covered here is refused."""
    lower = spec["normalizer"] is not None
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]] if lower else []
    if spec["model"]["type"] != "BPE" or kinds not in ([], ["NFC", "Replace", "Lowercase"]) or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("a vocabulary with options that aren't covered")
    return sorted((t["content"] for t in spec["added_tokens"]), key=lambda s: (-len(s), s))


@lru_cache(4)
def kinds_of(vocabulary: str) -> str:
    """The kind of each code point, L, N, S or O for others, as the library's pre-tokenizer treats it: a letter goes on
    after a letter, another sign after a sign, and so on.  Asked for runs first, one by one where a run is mixed."""
    splits = Tokenizer.from_str(vocabulary).pre_tokenizer.pre_tokenize_str
    removes = not splits(" ")

    def same(lead: str, text: str) -> bool:
        return [span for _, span in splits(lead + text)] == [(0, len(lead + text))]

    def kind(text: str) -> str:
        """Of a run, or "" if it is mixed."""
        if same("a", text):
            return "L"
        if same("!", text):
            return "O"
        if removes:  # numbers are a pre-token each, white space is none
            spans = [span for _, span in splits(text)]
            return "S" if not spans else "N" if spans == [(i, i + 1) for i in range(len(text))] and not any(same("!", c) or same("a", c) for c in text) else ""
        return "N" if same("1", text) else "S" if len(text) == 1 else ""

    out = []
    for at in range(0, 0x110000, RUN):
        if 0xD800 <= at < 0xE000:  # surrogates aren't text
            out.append("O" * RUN)
            continue
        run = "".join(map(chr, range(at, at + RUN)))
        out.append(kind(run) * RUN or "".join(map(kind, run)))
    return "".join(out)


def pattern_of(vocabulary: str, points: int = 0x110000) -> re.Pattern:
    """The vocabulary's pre-token pattern for texts of code points below ``points``."""
    kinds, spec = kinds_of(vocabulary), json.loads(vocabulary)
    ranges: dict[str, list[str]] = {"L": [], "N": [], "S": [], "O": []}
    for m in re.finditer("(.)\\1*", kinds[:points]):
        ranges[m[1]].append(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}")
    return re.compile((WORD_PATTERN if spec["normalizer"] else BYTE_PATTERN).format(**{k: "".join(v) for k, v in ranges.items()}))


class Encoder:
    """Encodes whole texts of one vocabulary; ``ids`` gives little-endian 32-bit ids, ``count`` only their number."""

    def __init__(self, vocabulary: str, shortcut: dict[str, int] | None = None, patterns: tuple[re.Pattern, re.Pattern] | None = None):
        self.library = Tokenizer.from_str(vocabulary)
        spec = json.loads(vocabulary)
        special = checked(spec)
        self.lower = spec["normalizer"] is not None
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.cuts = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        # the narrow pattern is the wide one for the first 256 code points, where its classes are faster
        self.narrow, self.wide = (p.findall for p in patterns or (pattern_of(vocabulary, 256), pattern_of(vocabulary)))
        self.shortcut = shortcut or {}
        self.alphabet = {chr(b): c for b, c in byte_alphabet().items()}
        merges, alphabet = self.library.model.tokenize, str.maketrans(self.alphabet)

        def merged(word: str) -> list:
            return merges(word.encode().decode("latin-1").translate(alphabet))

        class Counts(dict):
            def __missing__(self, word):
                if len(self) > CACHE_ENTRIES:
                    self.clear()
                    self.update(shortcut or {})
                n = self[word] = len(merged(word))
                return n

        class Ids(dict):
            def __missing__(self, word):
                if len(self) > CACHE_ENTRIES:
                    self.clear()
                out = self[word] = b"".join(t.id.to_bytes(4, "little") for t in merged(word))
                return out

        self.counts, self.packed = Counts(self.shortcut), Ids()

    def pre_tokens(self, text: str) -> list[str]:
        """Of a text without strings of special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(self.library.normalizer.normalize_str(text) if self.lower else text)
        return self.narrow(text.lower() if self.lower else text)

    def parts(self, text: str | None) -> list[str]:
        """The text between strings of special tokens (even places) and those strings (odd ones)."""
        if not text:
            return []
        if self.cuts and any(s in text for s in self.special):
            return self.cuts(text)
        return [text]

    def count(self, text: str | None) -> int:
        return sum(1 if k % 2 else sum(map(self.counts.__getitem__, self.pre_tokens(part))) for k, part in enumerate(self.parts(text)))

    def ids(self, text: str | None) -> bytes:
        return b"".join(self.special[part] if k % 2 else b"".join(map(self.packed.__getitem__, self.pre_tokens(part))) for k, part in enumerate(self.parts(text)))

    def shares(self, text: str | None) -> tuple[int, int]:
        """Pre-tokens of a text, and how many of them the shortcut counts."""
        found = [w for part in self.parts(text)[::2] for w in self.pre_tokens(part)]
        return len(found), sum(w in self.shortcut for w in found)


def whole_tokens(vocabulary: str) -> list[str]:
    """The proof, done offline on the driver: vocabulary strings that the library encodes alone as their one token and
    that the pre-token pattern leaves whole.  At most as many as the vocabulary has."""
    library, spec = Tokenizer.from_str(vocabulary), json.loads(vocabulary)
    back = {c: b for b, c in byte_alphabet().items()}
    split = pattern_of(vocabulary).findall
    found: dict[str, int] = {}
    for token, number in spec["model"]["vocab"].items():
        try:
            string = bytes(back[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split(string) == [string]:
            found[string] = number
    strings = list(found)
    encoded = library.encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, encoded, strict=True) if e.ids == [found[s]]]


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: str, patterns: tuple[re.Pattern, re.Pattern], shortcut: list[str] | None = None) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = hash((vocabulary, shortcut is None))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, dict.fromkeys(shortcut or [], 1), patterns)
    return _ENCODERS[key]


def described(path: str) -> tuple[str, tuple[re.Pattern, re.Pattern]]:
    """What an :func:`encoder` is made of, for a broadcast of the vocabulary's size."""
    vocabulary = vocabulary_text(path)
    return vocabulary, (pattern_of(vocabulary, 256), pattern_of(vocabulary))


def token_counter(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A column function that counts tokens.  The vocabulary file is read on the driver and broadcast; its size is that
    of the file and doesn't grow with the data."""
    vocabulary, patterns = described(path)
    shared = spark.sparkContext.broadcast((vocabulary, patterns, whole_tokens(vocabulary)))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = encoder(*shared.value).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return counted


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_counter(docs.sparkSession, path)(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
