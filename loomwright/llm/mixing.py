"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed into cells of (source, language, topic).  Raking scales the cells to three target marginals in
turn.  A cell's weight is tokens * a[source] * b[language] * g[topic], so a sweep is one job: sources, of which there
may be any number, are rows that hold their own cells and find their factor by themselves; the sums by language and
topic come to the driver, which finds the factors of those.  Sweeps end when no marginal is off by more than
``TOLERANCE`` of its target, at the latest after ``SWEEPS``; :func:`raked` reports the residual.  A document is then
sampled with probability min(1, scale * weight / tokens) of its cell, with the scale set so that the expected tokens
meet the budget, and its number is a hash of doc_id, so reruns and lost tasks choose alike.

Targets are shares that are given for some or all values of a dimension; what isn't given shares the rest by its
tempered share, share ** power (``TARGETS`` has the powers).

Topics are cells of the corpus that are fitted to it: each text's words are projected on ``PLANES`` hashes of their
letters, and a text lies on one side or the other of its language's mean over all documents, which makes 2 ** PLANES
topics for each language, of about the same size.

Defined cases: a null or empty text has no tokens, the topic "none", and is sampled with probability 1; null sources and
languages are classes of their own, apart from "" and "und", and are null in the output; equal doc_ids are sampled
alike; a null doc_id is hashed as an empty one; a target for a value that no document has is shared by the others; a
value with a target of 0 isn't sampled; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import materialize, sent, table

#: Powers that shares are tempered with, share of all tokens that is sampled, steps to find the scale.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET, STEPS, SEED = 0.6, 8, "mix-1"
#: Sweeps at most, and the part of its target that a marginal may be off by.
SWEEPS, TOLERANCE = 40, 1e-10
DIMS = ["source", "lang", "topic"]
#: Bytes of a row of means or rates in a broadcast table.
RATE_BYTES = 512
BLANKS = r"\x09-\x0D\x20"
WORDS = f"[^{BLANKS}]+"
#: Hashes of words to one bit: whether the first letter, the last letter, the second letter is one of a half.
PLANES = [
    rf"(?:\A|[{BLANKS}])[acegikmoqsuwyACEGIKMOQSUWY]",
    rf"[abefijmnqruvyzABEFIJMNQRUVYZ](?:[{BLANKS}]|\z)",
    rf"(?:\A|[{BLANKS}])[^{BLANKS}][abcdijklqrstyABCDIJKLQRSTY]",
]
Shares = dict[str, dict[str | None, float]]


def counts(docs: DataFrame) -> dict[str, Column]:
    """Source and language, the tokens (words) and the projections of each row."""
    text = F.coalesce("text", F.lit(""))
    planes = {f"plane{k}": F.regexp_count(text, F.lit(p)).cast("long") for k, p in enumerate(PLANES)}
    return {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "n_tokens": F.regexp_count(text, F.lit(WORDS)).cast("long"), **planes}


def with_topics(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, n_tokens, plane0 and so on) with their topic.  The languages' means are written and counted first, so
    that they travel and the rows, which may carry texts, stay where they are."""
    names = [f"plane{k}" for k in range(len(PLANES))]
    means = rows.groupBy(F.col("lang").alias("m_lang")).agg(*[(F.sum(n).cast("double") / F.nullif(F.sum("n_tokens"), F.lit(0))).alias(f"m_{n}") for n in names])
    digits = [F.when(F.col(n).cast("double") / F.nullif("n_tokens", F.lit(0)) > F.col(f"m_{n}"), "1").otherwise("0") for n in names]
    topic = F.when(F.col("n_tokens") == 0, "none").otherwise(F.concat(*digits))
    means = sent(materialize(rows.sparkSession, means), RATE_BYTES)
    return rows.join(means, F.col("lang").eqNullSafe(F.col("m_lang"))).withColumn("topic", topic).drop("m_lang", *names, *[f"m_{n}" for n in names])


def targets(sums: DataFrame, dim: str, power: float, total: float, given: dict[str | None, float] | None = None) -> DataFrame:
    """The target tokens of each value of ``dim``."""
    by = sums.groupBy(F.col(dim).alias("t_value")).agg(F.pow(F.sum("tokens") / total, F.lit(power)).alias("part"))
    if given:
        named = by.sparkSession.createDataFrame([(v, float(x)) for v, x in given.items()], "g_value string, share double")
        by = by.join(F.broadcast(named), F.col("t_value").eqNullSafe(F.col("g_value")), "left")
        rest = by.agg(F.sum(F.when(F.col("share").isNull(), F.col("part")))).first()[0] or 1.0
        by = by.withColumn("part", F.coalesce("share", F.lit(max(0.0, 1 - sum(given.values())) / rest) * F.col("part")))
    whole = by.agg(F.sum("part")).first()[0]
    return by.select("t_value", (F.col("part") / (whole or 1.0) * total).alias("target"))


def numbers(values: list[float]) -> Column:
    """Doubles as one value of the plan, however many there are."""
    return F.from_json(F.lit(repr([float(v) for v in values])), "array<double>")


def rake(spark: SparkSession, cells: DataFrame, powers: dict[str, float] = TARGETS, given: Shares | None = None, sweeps: int = SWEEPS) -> tuple[DataFrame, float]:
    """source, lang, topic, tokens, weight of each cell (source, lang, topic, tokens > 0), and the residual: what part of
    its target the worst marginal is off by.  Weights keep the total."""
    given = given or {}
    held = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()  # a row for each language and topic
    if not held:
        return cells.withColumn("weight", F.lit(0.0)), 0.0
    held.sort(key=lambda r: (r.lang is not None, r.lang or "", r.topic))
    total = float(sum(r.tokens for r in held))
    pairs = spark.createDataFrame([(r.lang, r.topic, float(r.tokens), k) for k, r in enumerate(held)], "p_lang string, p_topic string, tokens double, k int")
    goal = {name: {r.t_value: r.target for r in targets(pairs, f"p_{name}", powers[name], total, given.get(name)).collect()} for name in ("lang", "topic")}
    sources = targets(cells, "source", powers["source"], total, given.get("source"))
    own = cells.join(pairs.select("p_lang", "p_topic", "k"), F.col("lang").eqNullSafe(F.col("p_lang")) & (F.col("topic") == F.col("p_topic")))
    # one row for each source with its cells: at most as many as there are pairs
    rows = own.groupBy("source").agg(F.collect_list(F.struct("k", "tokens")).alias("own")).join(sources, F.col("source").eqNullSafe(F.col("t_value")))
    rows = materialize(spark, rows.select("source", "own", "target"))
    b, g = dict.fromkeys(goal["lang"], 1.0), dict.fromkeys(goal["topic"], 1.0)

    def weighted() -> DataFrame:
        factor = numbers([b[r.lang] * g[r.topic] for r in held])
        part = F.transform("own", lambda c: F.struct(c["k"].alias("k"), c["tokens"].alias("tokens"), (c["tokens"] * F.get(factor, c["k"])).alias("w")))
        whole = F.aggregate("own", F.lit(0.0), lambda s, c: s + c["w"])
        share = F.when(whole > 0, F.col("target") / whole).otherwise(0.0)
        return rows.withColumn("own", part).select("source", F.explode("own").alias("c"), share.alias("a")).select("source", "c.k", "c.tokens", (F.col("a") * F.col("c.w")).alias("weight"))

    def factor(target: float, sum_: float) -> float:
        return target / sum_ if sum_ > 0 else 0.0

    residual = 0.0
    for n in range(sweeps + 1):
        sums = {r.k: r.w for r in weighted().groupBy("k").agg(F.sum("weight").alias("w")).collect()}
        lang, topic = dict.fromkeys(b, 0.0), dict.fromkeys(g, 0.0)
        for k, r in enumerate(held):
            lang[r.lang] += sums.get(k, 0.0)
            topic[r.topic] += sums.get(k, 0.0)
        residual = max(abs(found[v] - want) / (want or total) for found, wants in ((lang, goal["lang"]), (topic, goal["topic"])) for v, want in wants.items())
        if residual <= TOLERANCE or n == sweeps:
            break
        by = {v: factor(goal["lang"][v], lang[v]) for v in b}
        topic = dict.fromkeys(g, 0.0)
        for k, r in enumerate(held):
            topic[r.topic] += sums.get(k, 0.0) * by[r.lang]
        b = {v: b[v] * by[v] for v in b}
        g = {t: g[t] * factor(goal["topic"][t], topic[t]) for t in g}
    names = pairs.select("k", F.col("p_lang").alias("lang"), F.col("p_topic").alias("topic"))
    return weighted().join(names, "k").select("source", "lang", "topic", "tokens", "weight"), residual


def rates(spark: SparkSession, cells: DataFrame, budget: float = BUDGET, given: Shares | None = None) -> DataFrame:
    """r_source, r_lang, r_topic, rate: the probability of each cell, so that ``budget`` of the tokens is expected."""
    raked = materialize(spark, rake(spark, cells.where("tokens > 0"), given=given)[0])
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    scale = float(budget)
    for _ in range(STEPS):  # what can't be sampled more than once is made up by the rest
        full = scale * F.col("weight") >= F.col("tokens")
        sure, rest = raked.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not rest:
            break
        scale = (budget * total - sure) / rest
    none = cells.where("tokens = 0").select(*DIMS, F.lit(1.0).alias("rate"))
    found = raked.select(*DIMS, F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("tokens")).alias("rate")).unionByName(none)
    return materialize(spark, found.select(*[F.col(d).alias(f"r_{d}") for d in DIMS], "rate"))


def rated(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` with the rate of their cell; the rates travel to the rows, unless there are too many cells for that."""
    same = F.lit(True)
    for d in DIMS:
        same = same & F.col(d).eqNullSafe(F.col(f"r_{d}"))
    return rows.join(sent(rates, RATE_BYTES), same)


def unit(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on doc_id and the seed alone."""
    digest = F.md5(F.concat(F.lit(SEED), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def sample(spark: SparkSession, docs: DataFrame, given: Shares | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, rate, sampled of each row."""
    rows = materialize(spark, docs.select("doc_id", *[c.alias(n) for n, c in counts(docs).items()]))
    told = with_topics(rows)
    cells = materialize(spark, told.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    return rated(told, rates(spark, cells, budget, given)).select("doc_id", *DIMS, "n_tokens", F.round("rate", 6).alias("rate"), (unit(F.col("doc_id")) < F.col("rate")).alias("sampled"))


def mixed(spark: SparkSession, docs: DataFrame, given: Shares | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of ``docs``, with its columns."""
    # the row travels as one value, so its columns can't clash with the counts, which are read without it
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = materialize(spark, docs.select(whole, unit(F.col("doc_id")).alias("unit"), *[c.alias(n) for n, c in counts(docs).items()]))
    cells = materialize(spark, with_topics(rows.drop("row", "unit")).groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    return rated(with_topics(rows), rates(spark, cells, budget, given)).where(F.col("unit") < F.col("rate")).select("row.*")


def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(spark, table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same over DuckDB, sweep by sweep."""
    t, n = "coalesce(text, '')", len(PLANES)
    planes = ", ".join(f"CAST(len(regexp_extract_all({t}, '{p}')) AS DOUBLE) AS c{k}" for k, p in enumerate(PLANES))
    means = ", ".join(f"sum(c{k}) / sum(n_tokens) AS m{k}" for k in range(n))
    digits = " || ".join(f"CASE WHEN c{k} / n_tokens > m{k} THEN '1' ELSE '0' END" for k in range(n))
    parts = [f"""
WITH t AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all({t}, '{WORDS}')) AS BIGINT) AS n_tokens, {planes} FROM documents),
m AS (SELECT lang, {means} FROM t GROUP BY lang),
d AS MATERIALIZED (SELECT doc_id, source, t.lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'none' ELSE {digits} END AS topic FROM t JOIN m ON t.lang IS NOT DISTINCT FROM m.lang),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
k AS (SELECT * FROM c WHERE tokens > 0),
total AS (SELECT sum(tokens) AS n FROM k)"""]
    for dim, power in TARGETS.items():
        parts.append(f"{dim}_part AS (SELECT {dim}, pow(sum(tokens) / (SELECT n FROM total), {power}) AS part FROM k GROUP BY {dim})")
        parts.append(f"{dim}_goal AS MATERIALIZED (SELECT {dim}, part / (SELECT sum(part) FROM {dim}_part) * (SELECT n FROM total) AS goal FROM {dim}_part)")
    goals = " ".join(f"JOIN {dim}_goal g_{dim} ON k.{dim} IS NOT DISTINCT FROM g_{dim}.{dim}" for dim in DIMS)
    parts.append(f"w0 AS MATERIALIZED (SELECT k.*, {', '.join(f'g_{dim}.goal AS {dim}_goal' for dim in DIMS)}, tokens AS w FROM k {goals})")
    last, number = "w0", 0
    for dim in DIMS * SWEEPS + ["source"]:
        number += 1
        parts.append(f"w{number} AS MATERIALIZED (SELECT * REPLACE (w * {dim}_goal / sum(w) OVER (PARTITION BY {dim}) AS w) FROM {last})")
        last = f"w{number}"
    parts.append(f"s0 AS (SELECT {BUDGET}::DOUBLE AS s)")
    for n in range(STEPS):
        rest = f"(SELECT sum(CASE WHEN s * w >= tokens THEN 0.0 ELSE w END) FROM {last})"
        sure = f"(SELECT sum(CASE WHEN s * w >= tokens THEN tokens ELSE 0 END) FROM {last})"
        parts.append(f"s{n + 1} AS MATERIALIZED (SELECT CASE WHEN {rest} > 0 THEN ({BUDGET} * (SELECT n FROM total) - {sure}) / {rest} ELSE s END AS s FROM s{n})")
    parts.append(f"""r AS (SELECT source, lang, topic, least(1.0, (SELECT s FROM s{STEPS}) * w / tokens) AS rate FROM {last}
  UNION ALL SELECT source, lang, topic, 1.0 FROM c WHERE tokens = 0)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(rate, 6) AS rate,
  CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < rate AS sampled
FROM d JOIN r ON {' AND '.join(f'd.{dim} IS NOT DISTINCT FROM r.{dim}' for dim in DIMS)}""")
    return ",\n".join(parts)


#: The same over DuckDB.
ORACLE = _sql()
