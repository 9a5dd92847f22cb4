"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, whose context is all
turns before it and whose reply alone is trained on.

Template: a turn is ``[INST] role NEWLINE text [/INST]`` without the spaces; the reply that is trained on is
``[INST]`` role NEWLINE, its text, ``</s>``.  Within roles and texts ``&``, ``<`` and ``[`` become ``&amp;``,
``&lt;`` and ``&#91;``, so no text can hold a control string, and the way back is exact.  What follows a conversation's
last assistant turn (or a conversation without one) is an example with a context and no reply, so that the output holds
every turn.

Defined cases: null texts and roles are empty; null turns come first; equal turn numbers are ordered by role, then
text; repeated rows are turns of their own; a row with a null conv_id is a conversation of its own, as nothing says which
rows would belong together; an empty table gives no examples; only conv_id, turn, role and text are read.  A conversation is one value by contract (its digest is of its
whole text), so it has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import table

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def expand(turns: DataFrame) -> DataFrame:
    """conv_id, example (the place of the reply, or of the end), formatted, loss_start, loss_length (in characters of
    ``formatted``; null where nothing is trained on), alone (tells rows without a conversation apart)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # rows without a conversation are told apart by a number, so they are spread like any others
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    gathered = turns.select("conv_id", alone, turn.alias("t")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # each turn is formatted once; an example joins the first of them
    marked = gathered.select(
        "conv_id",
        "alone",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escaped(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"))).alias("turns"),
    )
    places = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i).otherwise(F.lit(-1)))
    replies = F.filter(places, lambda i: i >= 0)
    ends = F.when(F.coalesce(F.element_at("turns", -1)["role"], F.lit("")) == "assistant", replies).otherwise(F.array_append(replies, F.size("turns")))
    each = marked.select("conv_id", "alone", "turns", F.explode(ends).alias("example"))
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("example")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    reply = F.get("turns", F.col("example"))
    prompt = F.concat(context, F.coalesce(reply["head"], F.lit("")))
    built = each.select("conv_id", "alone", "example", prompt.alias("prompt"), reply["body"].alias("body"))
    return built.select(
        "conv_id",
        "example",
        F.when(F.col("body").isNull(), F.col("prompt")).otherwise(F.concat("prompt", F.col("body"), F.lit(END))).alias("formatted"),
        F.when(F.col("body").isNotNull(), F.char_length("prompt")).alias("loss_start"),
        F.char_length("body").alias("loss_length"),
        "alone",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """The digests of each conversation, from formatted text and loss spans alone: the longest example holds all turns,
    the loss spans hold each assistant text once."""
    under = F.when(F.col("loss_start").isNotNull(), unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))))
    by = examples.groupBy("conv_id", "alone").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(under.isNotNull(), F.struct(F.col("example"), under.alias("text"))))), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
    )
    # one split at the opening marks; a role ends at the first newline that isn't part of it, which roles can't hold
    parts = F.slice(F.split("whole", r"\[INST\]"), 2, F.size(F.split("whole", r"\[INST\]")) - 1)
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"(\[/INST\]|</s>)\z", ""))
    return by.select(
        "conv_id",
        F.size(bare).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(bare, lambda p: F.concat(unescaped(p), F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op10_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(expand(turns.unionByName(extra)))


#: The same over DuckDB: lengths of the formatted text are summed instead of building it.
ORACLE = """
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id, alone) AS n,
  7 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS own FROM t),
s AS (SELECT *, coalesce(sum(own + 7) OVER (PARTITION BY conv_id, alone ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN before + own + 4 WHEN k = n THEN before + own + 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id, alone
"""
