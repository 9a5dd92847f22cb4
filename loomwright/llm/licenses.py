"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line, or a run of words over several lines that is no longer than the template's words / ``THRESHOLD``.  A
block matches a template if it holds at least ``THRESHOLD`` of the template's distinct words.  Runs hold no word of a
line that matches by itself and don't overlap; where they would, the one that holds most goes first, then the shortest.
The join is exact and filtered three ways, over one global order of the templates' words, rarest first, counted over
every block of the corpus:
prefix - a template of n words of which m must be there can only match a block that holds one of its n - m + 1 rarest;
length - a block needs m distinct words of the vocabulary;
position - where the first common word stands at place p of the template and s of the block's own ordered words, no
more than min(n - p, size - s) words can be common.
Runs over lines are sought from the places of a template's words, in texts that hold as many as must be there.  The SQL
has lines only, so it gives the same rows where no notice is wrapped.
The templates are a parameter of bounded size and travel to the blocks, so that the texts aren't shuffled.

Base labels are places where a phrase's words follow each other, anywhere in a text; they are kept beside the
method's.  The score is 1 with a base place, else the largest containment among matches, else 0.

Defined cases: a null text is empty; no word gives counts of 0 and empty labels; without a base place first_word and
last_word are null; repeated rows are scanned each; extra columns aren't read; there is no length limit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import table

THRESHOLD = 0.8
#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as licenses ask for them or as they are commonly given, and paragraphs of the licenses' own
#: texts (MIT, Apache 2.0, GPL 3, LGPL 3, BSD, MPL 2.0, ISC, zlib, Boost, Unlicense, EPL 2.0, Creative Commons).
TEMPLATES = {
    "mit-notice": ("mit", "Released under the MIT License"),
    "mit-grant": ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "apache-notice": ("apache-2", "Licensed under the Apache License, Version 2.0"),
    "apache-file": ("apache-2", "you may not use this file except in compliance with the License"),
    "cc-by-nc-notice": ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    "cc-by-nc-title": ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "gpl-notice": ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    "gpl-grant": ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    "bsd-grant": ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "mpl-notice": ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    "reserved": ("all-rights-reserved", "All rights reserved"),
    "mit-conditions": ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    "mit-dealing": ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    "mit-warranty": ("mit", "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    "apache-warranty": ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    "apache-limitations": ("apache-2", "See the License for the specific language governing permissions and limitations under the License"),
    "apache-grant": ("apache-2", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    "gpl-warranty": ("gpl-3", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    "gpl-copy": ("gpl-3", "You should have received a copy of the GNU General Public License along with this program"),
    "lgpl-combined": ("lgpl-3", "You may convey a Combined Work under terms of your choice that, taken together, effectively do not restrict modification of the portions of the Library contained in the Combined Work and reverse engineering for debugging such modifications"),
    "bsd-source": ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    "bsd-endorse": ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "mpl-secondary": ("mpl-2", "This Source Code Form is Incompatible With Secondary Licenses, as defined by the Mozilla Public License"),
    "isc-grant": ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "zlib-origin": ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required"),
    "zlib-altered": ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    "boost-notice": ("boost-1", "Distributed under the Boost Software License, Version 1.0"),
    "unlicense-domain": ("unlicense", "This is free and unencumbered software released into the public domain"),
    "unlicense-grant": ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    "epl-notice": ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "cc0-dedication": ("cc0-1", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    "cc-by-sa-notice": ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike license"),
}
#: Bytes that aren't in words become blanks, A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Index:
    """The templates over the global order of their words, and an inverted list of their prefixes."""

    def __init__(self, templates: dict[str, tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.templates, self.threshold = [], threshold
        sets = {name: (label, set(words_of(text))) for name, (label, text) in templates.items()}
        order = sorted(set().union(*(s for _, s in sets.values())) if sets else (), key=lambda w: (frequency.get(w, 0), w))
        self.place = {w: i for i, w in enumerate(order)}
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for name, (label, words) in sets.items():
            own = sorted(self.place[w] for w in words)
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            for p in range(len(own) - need + 1):
                self.prefix.setdefault(own[p], []).append((len(self.templates), p))
            self.templates.append((name, label, own, need))
        self.spans = {name: math.ceil(len(words_of(text)) / threshold - 1e-9) for name, (_, text) in templates.items()}

    def matches(self, words: list[bytes]) -> list[tuple[str, str, float]]:
        """(template, label, containment) of a block's words."""
        place = self.place
        block = sorted({place[w] for w in words if w in place})
        out, done = [], set()
        for s, token in enumerate(block):
            for number, p in self.prefix.get(token, ()):
                if number in done:
                    continue
                done.add(number)  # the first common word in the order decides
                name, label, own, need = self.templates[number]
                if len(block) < need or min(len(own) - p, len(block) - s) < need:
                    continue
                common = len(set(own[p:]).intersection(block[s:]))
                if common >= need:
                    out.append((name, label, common / len(own)))
        return out

    def across(self, lines: list[list[bytes]], taken: set[tuple[str, int]]) -> list[tuple[int, int, int, str, str, float]]:
        """(line, first word, words, template, label, containment) of runs over several lines; ``taken`` has the template
        and line of blocks that match by themselves."""
        place, out = self.place, []
        present = {place[w] for w in place.keys() & set().union(*lines)}
        wanted = [t for t in self.templates if len(present.intersection(t[2])) >= t[3]]
        if len(lines) < 2 or not wanted:
            return out
        known, first = [], 0
        for n, line in enumerate(lines):
            known += [(first + k, n, place[w]) for k, w in enumerate(line) if w in place]
            first += len(line)
        for name, label, own, need in wanted:
            words, span = set(own), self.spans[name]
            hits = [h for h in known if h[2] in words and (name, h[1]) not in taken]

            def run(start: int) -> tuple[int, int, int, int]:
                held, last, at = set(), start, start
                while at < len(hits) and hits[at][0] - hits[start][0] < span:
                    if hits[at][2] not in held:
                        held.add(hits[at][2])
                        last = at
                    at += 1
                return len(held), hits[start][0] - hits[last][0], start, last

            at = 0
            while at < len(hits):
                found = run(at)
                if found[0] < need:
                    at += 1
                    continue
                common, back, start, last = max(run(k) for k in range(at, found[3] + 1))
                out.append((hits[start][1], hits[start][0], 1 - back, name, label, common / len(own)))
                at = last + 1
        return out


def frequencies(docs: DataFrame, templates: dict[str, tuple[str, str]]) -> dict[bytes, int]:
    """Blocks of the whole corpus that hold each word of the templates."""
    vocabulary = frozenset().union(*(words_of(text) for _, text in templates.values()))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for line in text.split("\n"):
                    found.update(vocabulary.intersection(words_of(line)))
        yield pd.DataFrame({"word": list(found), "n": list(found.values())}).astype({"n": "int64"})

    rows = docs.select("text").where("text is not null").mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}  # as many as the templates have words


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place of a phrase."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        before, counted, at = 0, 0, joined.find(sought)
        while at >= 0:
            before, counted = before + joined.count(b" ", counted, at), at  # each byte is counted once
            out.append((before, label))
            at = joined.find(sought, at + 1)
    return out


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
MATCHED = "doc_id long, line long, first_word long, n_words long, template string, label string, containment double"


def index_of(docs: DataFrame, templates: dict[str, tuple[str, str]], threshold: float) -> Index:
    return Index(templates, frequencies(docs, templates), threshold)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def block_matches(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Each block that matches a template: its (first) line (from 0), its first word and length in words, and the containment."""
    shared = docs.sparkSession.sparkContext.broadcast(index_of(docs, templates, threshold))

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                first, taken = 0, set()
                lines = [words_of(line) for line in text.split("\n")]
                for n, words in enumerate(lines):
                    found = shared.value.matches(words)
                    taken.update((m[0], n) for m in found)
                    rows += [(doc, n, first, len(words), *m) for m in found]
                    first += len(words)
                rows += [(doc, *m) for m in shared.value.across(lines, taken)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCHED.split(", ")]).astype({"doc_id": "Int64", "containment": "float64"})

    return keyed(docs).mapInPandas(matched, MATCHED)


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(index_of(docs, templates, threshold))

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        vocabulary = index.place.keys()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words, found, taken = [], [], set()
                lines = [words_of(line) for line in text.split("\n")]
                for n, own in enumerate(lines):
                    words += own
                    if not vocabulary.isdisjoint(own):
                        matched = index.matches(own)
                        taken.update((m[0], n) for m in matched)
                        found += matched
                found += [m[3:] for m in index.across(lines, taken)]
                base = places(words)
                starts = [p for p, _ in base]
                labels = {label for _, label in base}
                score = 1.0 if base else max((m[2] for m in found), default=0.0)
                rows.append((doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {m[1] for m in found})), score, len(found)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return keyed(docs).mapInPandas(scanned, SCANNED)


def op5_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    templates = ", ".join(f"('{label}', {[w.decode() for w in sorted(set(words_of(text)))]!r})" for label, text in TEMPLATES.values())
    phrases = ", ".join(f"('{label}', {p.split()[0]!r}, {p.split()[1]!r}, {p.split()[2]!r}, {(p.split() + [None])[3]!r})".replace("None", "NULL") for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '{pattern}')) AS word, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) - 1 AS pos FROM d),
f AS (SELECT r, pos, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
p(label, p1, p2, p3, p4) AS (VALUES {phrases}),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
      FROM f JOIN p ON w1 = p1 AND w2 = p2 AND w3 = p3 AND (p4 IS NULL OR w4 = p4) GROUP BY r),
l AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{pattern}')) AS line FROM d),
q(label, words) AS (VALUES {templates}),
m AS (SELECT r, label, len(list_intersect(words, line)) / len(words) AS part FROM l JOIN q ON list_has_any(line, words)),
g AS (SELECT r, list(DISTINCT label) AS labels, max(part) AS part, count(*) AS n_blocks FROM m WHERE part >= {THRESHOLD} - 1e-9 GROUP BY r),
n AS (SELECT r, count(*) AS n_words FROM w GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM d LEFT JOIN n USING (r) LEFT JOIN b USING (r) LEFT JOIN g USING (r)
"""


#: The same over DuckDB.
ORACLE = _sql()
