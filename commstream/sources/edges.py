"""Reading graphs: edge lists in text, Parquet, and projections of node and relation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commstream.config import InvalidInput

SCHEMA = "src long, dst long, weight double"


def literal(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Edges from (src, dst) or (src, dst, weight) tuples."""
    return spark.createDataFrame([(r[0], r[1], float(r[2]) if len(r) > 2 and r[2] is not None else None) for r in rows], SCHEMA)


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines ``src dst [weight]`` with line and ok; comments (#) and blank lines go."""
    text = lines.select(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")).alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = text.withColumn("p", F.split("line", " "))
    out = parts.select("line", F.expr("try_cast(p[0] as bigint)").alias("src"), F.expr("try_cast(get(p, 1) as bigint)").alias("dst"), F.expr("try_cast(get(p, 2) as double)").alias("weight"), F.size("p").alias("n"))
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("n").between(2, 3) & ((F.col("n") == 2) | F.col("weight").isNotNull())
    return out.withColumn("ok", ok).drop("n")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a text file; a malformed line is an error that shows it."""
    lines = parsed(spark.read.text(path))
    bad = lines.where("not ok").first()
    if bad:
        raise InvalidInput(f"not an edge: {bad['line'][:200]!r}")
    return lines.select("src", "dst", "weight")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a Parquet table with src, dst and perhaps weight."""
    edges = spark.read.parquet(path)
    missing = {"src", "dst"} - set(edges.columns)
    if missing:
        raise InvalidInput(f"{path} has no column {', '.join(sorted(missing))}")
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(None).cast("double")
    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), weight.alias("weight"))


def dense_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, v): numbers 0, 1, ... in order of the names, from ranges and their counts."""
    ranged = names.select(F.col(column).alias("name")).dropna().distinct().withColumn("range", F.substring(F.md5(F.col("name").cast("string")), 1, 2))
    # Ids follow the digest, so that ranges are even whatever the names are.
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.md5(F.col("name").cast("string")), "name")) - 1
    return ranged.withColumn("at", within).join(starts, "range").select("name", (F.col("before") + F.col("at")).cast("long").alias("v"))


def project(relations: DataFrame, from_col: str, to_col: str, weight_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges over dense ids and (name, v) from a relation table of any database snapshot."""
    names = relations.select(F.col(from_col).cast("string").alias("name")).unionByName(relations.select(F.col(to_col).cast("string").alias("name")))
    ids = dense_ids(names)
    at = lambda c, end: ids.select(F.col("name").alias(c), F.col("v").alias(end))
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(None).cast("double")
    rows = relations.select(F.col(from_col).cast("string").alias("a"), F.col(to_col).cast("string").alias("b"), weight.alias("weight"))
    return rows.join(at("a", "src"), "a").join(at("b", "dst"), "b").select("src", "dst", "weight"), ids
