import random
import re
import time

import duckdb

from loomwright.llm import licenses as x

SCHEMA = "doc_id long, text string, labels string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(doc, text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    base = [(k, label) for p, label in x.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    found = []
    for line in text.split("\n"):
        own = set(WORD.findall(line))
        for label, template in x.TEMPLATES.values():
            want = set(WORD.findall(template.lower()))
            if len(own & want) >= x.THRESHOLD * len(want) - 1e-9:
                found.append((label, len(own & want) / len(want)))
    starts = [k for k, _ in base]
    return (doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted({b for _, b in base} | {f for f, _ in found})), 1.0 if base else max((c for _, c in found), default=0.0), len(found))


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_hard_rows(spark):
    docs = [(1, None), (2, ""), (3, "-- !!"), (4, "Under the MIT License under the mit\nlicense"), (5, "Apache License, Version 2.0 CC-BY-NC cc by nc by nc"), (None, "Released under the mit license"), (5, "All rights reserved"), (6, "rights all. İÉ é"), (7, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated files"), (8, "mit " * 200_000 + "cc by nc"), (9, "Licensed under the Apache License"), (10, "you may not use this file except in compliance with License")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], SCHEMA)
    assert key(x.scan(df).collect()) == key(brute(d, t) for d, t in docs)
    assert x.scan(df.limit(0)).count() == 0
    found = x.block_matches(df).where("doc_id = 7").collect()
    assert [(r.line, r.first_word, r.label) for r in found] == [(0, 0, "mit")]


def test_query_against_brute_force_and_sql(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    have = key(x.op5_license_set_join(spark, tiny).collect())
    assert have == key(brute(d, t) for d, t in docs)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    assert have == key(db.execute(x.ORACLE).fetchall())


def test_places_are_linear():
    words = b"cc by nc".split() * 60_000
    began = time.time()
    found = x.places(words)
    assert [k for k, _ in found] == list(range(0, 180_000, 3)) and time.time() - began < 5


def test_hundreds_of_templates(spark):
    """The filters lose nothing: 400 templates over a shared vocabulary, against all pairs."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(120)]
    templates = {f"t{k}": (f"l{k % 90}", " ".join(rng.choices(words, [1 / (i + 1) for i in range(120)], k=rng.randrange(3, 30)))) for k in range(400)}
    lines = [" ".join(w for w in rng.choice(list(templates.values()))[1].split() if rng.random() < 0.9) + " " + " ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(500)]
    want = set()
    for n, line in enumerate(lines):
        own = set(line.split())
        for name, (label, text) in templates.items():
            t = set(text.split())
            if len(own & t) >= x.THRESHOLD * len(t) - 1e-9:
                want.add((n, name, label, len(own & t) / len(t)))
    have = {(r.doc_id, r.template, r.label, r.containment) for r in x.block_matches(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), templates).collect()}
    assert have == want and len(want) > 500
