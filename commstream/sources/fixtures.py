"""Graphs derived from the test tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commstream.operators.graph import compress


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and of the suppliers they buy from; weight: line items."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return compress(rows.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.lit(1).cast("long").alias("w")))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("v"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, c): each nation's region as its community."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("v"), F.col("n_regionkey").cast("long").alias("c"))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, c): regions with nations 3, 10 and 17 moved to the next region."""
    return regions(spark, sf_dir).select("v", F.when(F.col("v").isin(3, 10, 17), (F.col("c") + 1) % 5).otherwise(F.col("c")).alias("c"))


def user_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): users of consecutive events of one day and type."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy(F.to_date("ts"), "event_type").orderBy("ts", "event_id")
    return e.select(F.col("user_id").cast("long").alias("src"), F.lead("user_id").over(order).cast("long").alias("dst")).where("dst is not null and src <> dst")


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(user_arcs(spark, sf_dir).withColumn("w", F.lit(1).cast("long")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("v")).distinct()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).select("v", (F.col("v") % 7).alias("c"))


def doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share lines: all pairs of the holders of a line, or where more than 50 documents hold it, a
    star around the smallest of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = d.select("doc_id", F.trim("line").alias("line")).where("line <> ''").select("doc_id", F.md5("line").alias("line")).distinct()
    shared = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n >= 2")
    held = lines.join(shared, "line")
    few = held.where("n <= 50")
    pairs = few.select("line", F.col("doc_id").alias("src")).join(few.select("line", F.col("doc_id").alias("dst")), "line").where("src < dst").select("src", "dst")
    star = held.where("n > 50 and doc_id > least").select(F.col("least").alias("src"), F.col("doc_id").alias("dst"))
    return pairs.unionByName(star).groupBy("src", "dst").agg(F.count("*").alias("w"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("v")).distinct()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, s): documents by the smallest document of their source."""
    d = table(spark, sf_dir, "documents")
    first = d.groupBy("source").agg(F.min("doc_id").alias("s"))
    return d.join(first, "source").select(F.col("doc_id").alias("v"), "s")


SQL = {
    "nation": """nation_e AS (SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS src, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS dst, CAST(count(*) AS BIGINT) AS w
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""",
    "regions": "regions AS (SELECT CAST(n_nationkey AS BIGINT) AS v, CAST(n_regionkey AS BIGINT) AS c FROM nation)",
    "shifted": "shifted AS (SELECT CAST(n_nationkey AS BIGINT) AS v, CAST(CASE WHEN n_nationkey IN (3, 10, 17) THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS BIGINT) AS c FROM nation)",
    "arcs": """arcs AS (SELECT src, dst FROM (SELECT CAST(user_id AS BIGINT) AS src, CAST(lead(user_id) OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS BIGINT) AS dst FROM events) AS a WHERE dst IS NOT NULL AND src <> dst)""",
    "user": "user_e AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(count(*) AS BIGINT) AS w FROM arcs GROUP BY 1, 2)",
    "segments": "segments AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS v, CAST(user_id % 7 AS BIGINT) AS c FROM events)",
    "doc": """doc_lines AS (SELECT DISTINCT doc_id, md5(trim(line)) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS l WHERE trim(line) <> ''),
      doc_shared AS (SELECT line, count(*) AS n, min(doc_id) AS least FROM doc_lines GROUP BY line HAVING count(*) >= 2),
      doc_held AS (SELECT doc_id, line, n, least FROM doc_lines JOIN doc_shared USING (line)),
      doc_pairs AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM doc_held a JOIN doc_held b ON a.line = b.line AND a.doc_id < b.doc_id WHERE a.n <= 50 UNION ALL SELECT least, doc_id FROM doc_held WHERE n > 50 AND doc_id > least),
      doc_e AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS w FROM doc_pairs GROUP BY 1, 2)""",
}
