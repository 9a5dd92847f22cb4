"""Workload queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import workloads as w
from loomwright.plans.registry import query
from loomwright.session import table


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice), 4) AS revenue, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY l_returnflag")
def w_revenue_by_product(spark: SparkSession, sf: str) -> DataFrame:
    return w.revenue_by(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query("SELECT r_name, count(*) AS orders, round(sum(l_quantity), 4) AS units, round(sum(l_quantity * l_discount), 4) AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_quantity > 0 AND l_discount > 0 GROUP BY r_name")
def w_region_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    lines = w.clean(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount"), "l_quantity", "l_discount")
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    return w.breakdown(lines.join(places, "l_suppkey"), "r_name", "l_quantity", "l_discount")


@query("SELECT round(avg(p_size), 6) AS mean_p_size, round(avg(p_retailprice), 6) AS mean_p_retailprice FROM part")
def w_means(spark: SparkSession, sf: str) -> DataFrame:
    return w.means(table(spark, sf, "part"), "p_size", "p_retailprice")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def w_categories(spark: SparkSession, sf: str) -> DataFrame:
    return w.distribution(table(spark, sf, "customer"), "c_mktsegment")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def w_word_freq(spark: SparkSession, sf: str) -> DataFrame:
    return w.word_frequency(table(spark, sf, "documents"), "text")


@query("SELECT count(text) AS reads, round(avg(length(text)), 4) AS mean_length, round(sum(length(text) - length(translate(text, 'GCgc', ''))) * 100 / sum(length(text)), 4) AS percent FROM benchmark")
def w_text_qc(spark: SparkSession, sf: str) -> DataFrame:
    return w.sequence_qc(table(spark, sf, "benchmark"), "text")


@query("SELECT count(*) AS total, count(DISTINCT text) AS distinct_rows, round(1 - count(DISTINCT text) / count(*), 6) AS duplicate_rate FROM documents WHERE text IS NOT NULL")
def w_dup_rate(spark: SparkSession, sf: str) -> DataFrame:
    return w.duplicate_rate(table(spark, sf, "documents").where("text is not null"), "text")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE l_discount > 0 AND l_tax > 0) AS kept, count(*) - count(*) FILTER (WHERE l_discount > 0 AND l_tax > 0) AS dropped FROM lineitem")
def w_validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return w.validation_report(table(spark, sf, "lineitem"), (F.col("l_discount") > 0) & (F.col("l_tax") > 0))


_BY_USER = "PARTITION BY user_id ORDER BY event_id"


@query(f"WITH x AS (SELECT user_id, event_id, value, row_number() OVER ({_BY_USER}) AS n, lag(value, 2) OVER ({_BY_USER}) AS l FROM events) SELECT user_id, event_id, CAST(n AS INTEGER) AS n, round((value - l) / 3, 6) AS trend FROM x WHERE n >= 3")
def w_rolling_trend(spark: SparkSession, sf: str) -> DataFrame:
    return w.rolling_trend(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 3).drop("value")


@query(
    f"""WITH x AS (SELECT user_id, event_id, row_number() OVER ({_BY_USER}) AS n, v - lag(v, 1, 0.0) OVER ({_BY_USER}) AS d FROM (SELECT *, round(value * 100) AS v FROM events)),
y AS (SELECT user_id, event_id, n, sum(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS t, sum(d * d) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS s FROM x)
SELECT user_id, event_id, CAST(n AS INTEGER) AS n, round((s - t * t / 4) / 3, 3) AS variance FROM y WHERE n >= 4"""
)
def w_rolling_var(spark: SparkSession, sf: str) -> DataFrame:
    """In squared hundredths: sums of whole numbers are the same in any order."""
    return w.rolling_variance(table(spark, sf, "events").select("user_id", "event_id", F.round(F.col("value") * 100).alias("value")), ["user_id"], ["event_id"], "value", 4, 3).drop("value")


@query(
    """WITH x AS (SELECT event_type, event_id, value - avg(value) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, event_id, CASE WHEN sum(abs(c)) OVER (PARTITION BY event_type) > 1e-12 THEN round(c / sum(abs(c)) OVER (PARTITION BY event_type), 6) ELSE 0.0 END AS weight FROM x"""
)
def w_center_weights(spark: SparkSession, sf: str) -> DataFrame:
    return w.centred_weights(table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "value").drop("value")


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def w_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return w.running_total(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value").drop("value")


@query(f"WITH x AS (SELECT user_id, event_id, round(value / avg(value) OVER (PARTITION BY user_id), 6) AS scaled, row_number() OVER ({_BY_USER}) AS n FROM events) SELECT user_id, event_id, scaled FROM x WHERE n > 1")
def w_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return w.mean_scaled(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value").drop("value")


@query(
    """WITH c AS (SELECT p_brand, l_returnflag, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_brand, first(n) FILTER (WHERE l_returnflag = 'A') AS "A", first(n) FILTER (WHERE l_returnflag = 'N') AS "N", first(n) FILTER (WHERE l_returnflag = 'R') AS "R" FROM c GROUP BY p_brand"""
)
def w_pivot_matrix(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("p_brand", "l_returnflag").agg(F.count("*").alias("n"))
    return w.count_matrix(counts, "p_brand", "l_returnflag", "n", ["A", "N", "R"])


@query("SELECT s_name AS name, s_acctbal AS balance, 'supplier' AS source FROM supplier UNION ALL SELECT c_name, c_acctbal, 'customer' FROM customer")
def w_concat_tag(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return w.concat_tagged({"supplier": s, "customer": c})


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def w_sort_desc(spark: SparkSession, sf: str) -> DataFrame:
    return w.sorted_desc(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT n_name FROM nation ORDER BY n_name")
def w_sort_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_name").orderBy("n_name")


@query("SELECT p_partkey, upper(p_name) AS p_name FROM part")
def w_upper(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("p_name"))


@query("SELECT item_id, md5(text) AS digest FROM benchmark")
def w_md5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(pow(sin(CAST(x AS DOUBLE)), 2) + pow(cos(CAST(x AS DOUBLE)), 2), 6)) AS v FROM embeddings")
def w_array_sincos(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", w.sincos(F.col("embedding").cast("array<double>")).alias("v"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 2.5, 6)) AS v FROM embeddings")
def w_array_scale(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", w.scaled(F.col("embedding"), 2.5).alias("v"))


_LEVEL = """SELECT k // 2 AS k, CASE WHEN count(*) = 1 THEN any_value(v) ELSE list_transform(list_zip(arg_min(v, k), arg_max(v, k)), lambda x: (x[1] + x[2]) / 2) END AS v FROM {0} GROUP BY k // 2"""


@query(f"WITH a AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), b AS ({_LEVEL.format('a')}), c AS ({_LEVEL.format('b')}) SELECT k AS vec_id, list_transform(v, lambda x: round(x, 6)) AS v FROM c")
def w_tree_mean(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(0.0)  # -0.0 comes in as 0.0, as the SQL's arg_min over lists has it
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") + zero).alias("v"))
    return w.tree_mean(rows, "vec_id", "v", 2).select("vec_id", F.transform("v", lambda x: w.rounded(x, 6)).alias("v"))


@query(
    """WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value FROM events),
a AS (SELECT user_id, event_id, round((value - lag(value, 1) OVER (PARTITION BY user_id ORDER BY event_id)) / 2, 6) AS trend_2, n FROM t),
b AS (SELECT user_id, event_id, round((value - lag(value, 3) OVER (PARTITION BY user_id ORDER BY event_id)) / 4, 6) AS trend_4, n FROM t)
SELECT user_id, event_id, trend_2, trend_4 FROM (SELECT * FROM a WHERE n >= 2) FULL JOIN (SELECT * EXCLUDE (n) FROM b WHERE n >= 4) USING (user_id, event_id)"""
)
def w_feature_join(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    spans = {str(k): w.rolling_trend(e, ["user_id"], ["event_id"], "value", k).select("user_id", "event_id", F.col("trend").alias(f"trend_{k}")) for k in (2, 4)}
    return w.joined_features(spans, ["user_id", "event_id"])


@query("SELECT n_regionkey, '== ' || n_regionkey || ' ==' || chr(10) || string_agg(n_name, chr(10) ORDER BY n_nationkey) AS report FROM nation GROUP BY n_regionkey")
def w_sectioned_report(spark: SparkSession, sf: str) -> DataFrame:
    return w.sectioned_report(table(spark, sf, "nation"), "n_regionkey", "n_name", "n_nationkey")


@query("SELECT p_brand, round(sum(p_size * l_quantity), 6) AS score FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def w_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    weights = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_brand", F.col("p_size").alias("weight"))
    readings = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("reading"))
    return w.keyed_score(weights, readings, ["key"], "p_brand")
