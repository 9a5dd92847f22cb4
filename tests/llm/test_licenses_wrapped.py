import math
import random
import textwrap

import pytest

from loomwright.llm import licenses as x

SCHEMA = "doc_id long, text string"
USUAL = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "gpl-3": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
    "mpl-2": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not",
}


def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA)


@pytest.mark.parametrize("label", sorted(USUAL))
def test_usual_wrapped_headers(spark, label):
    docs = frame(spark, [(1, "some words before\n" + USUAL[label] + "\nand some after")])
    row = x.scan(docs).first()
    assert (row.labels, row.score, row.n_blocks) == (label, 1.0, 1)
    found = x.block_matches(docs).collect()
    assert [(r.line, r.label, r.containment) for r in found] == [(1, label, 1.0)] and found[0].first_word == 3


def test_any_width(spark):
    cases = [(label, textwrap.fill(text, w, break_long_words=False)) for label, text in x.TEMPLATES.values() for w in (1, 9, 17, 30, 60, 200)]
    rows = {r.doc_id: r for r in x.scan(frame(spark, [(k, text) for k, (_, text) in enumerate(cases)])).collect()}
    for k, (label, text) in enumerate(cases):
        assert (rows[k].labels, rows[k].n_blocks) == (label, 1) and rows[k].score >= x.THRESHOLD, text


def test_runs_against_brute_force():
    """Whether any window over lines holds enough, by all windows; runs don't overlap and keep their length."""
    rng = random.Random(3)
    index = x.Index(x.TEMPLATES, {}, x.THRESHOLD)
    hit = 0
    for _ in range(400):
        label, text = rng.choice(list(x.TEMPLATES.values()))
        words = [w for w in x.words_of(text) if rng.random() < 0.93]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice([b"other", b"the", b"license"]))
        words = [b"the", b"x"] * rng.randrange(3) + words + [b"of", b"x"] * rng.randrange(3)
        lines = [[]]
        for w in words:
            lines[-1].append(w)
            if rng.random() < 0.25:
                lines.append([])
        taken = {(m[0], n) for n, line in enumerate(lines) for m in index.matches(line)}
        found = index.across(lines, taken)
        for name, (_, template) in x.TEMPLATES.items():
            want = set(x.words_of(template))
            need, span = math.ceil(x.THRESHOLD * len(want) - 1e-9), math.ceil(len(x.words_of(template)) / x.THRESHOLD - 1e-9)
            flat = [None if (name, n) in taken else w for n, line in enumerate(lines) for w in line]
            most = max((len(want.intersection(flat[k : k + span])) for k in range(len(flat))), default=0)
            mine = [m for m in found if m[3] == name]
            hit += bool(mine)
            assert bool(mine) == (most >= need)
            assert all(m[2] <= span and len(want.intersection(flat[m[1] : m[1] + m[2]])) == round(m[5] * len(want)) >= need for m in mine)
            assert all(a[1] + a[2] <= b[1] for a, b in zip(mine, mine[1:]))
    assert hit > 100


def test_far_words_and_whole_lines(spark):
    far = "released\n" + "some filler words here\n" * 3 + "under the\nmit and other\nlicense"
    docs = [(1, far), (2, "Released under the MIT License\nthe"), (3, "Released under\nthe MIT License\nReleased under the MIT License\nAll rights\n\nreserved")]
    rows = {r.doc_id: (r.labels, r.n_blocks) for r in x.scan(frame(spark, docs)).collect()}
    assert rows[1] == ("mit", 1) and rows[2] == ("mit", 1) and rows[3] == ("all-rights-reserved,mit", 3)
    assert x.scan(frame(spark, [(1, "released\n" + "some filler words here\n" * 3 + "under\n" + "more filler words\n" * 3 + "mit\nlicense")])).first().labels == ""
