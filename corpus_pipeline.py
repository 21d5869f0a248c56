"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last returns tokens.
Extra columns pass through the first four as they are, whatever their names. Texts of any length are treated whole,
null texts as each stage states, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commstream.llm import bpe, language_id, mixing, ngram_jaccard, pii, textkit
from commstream.storage import materialize

LEAST_LANGUAGE_SCORE = 0.3
NOISE_ROWS = 400


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are null or without a letter go, and those that the network takes for no language.

    Learned from the documents that have a language and from NOISE_ROWS generated texts in none. Where no document has
    a language, all with a letter stay. Repeated rows stay as often as they come.
    """
    textkit.bound_batches(spark)
    return language_id.keep_identified(docs, language_id.train(docs, noise_rows=NOISE_ROWS), LEAST_LANGUAGE_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of smallest id stays.

    Rows are told apart by id and text, so that two texts of one id, or of none, are two documents; rows alike in both
    are one. A document with an id stays before one without. Null and empty texts are near to nothing.
    """
    own = F.xxhash64("doc_id", "text").alias("own")
    keyed = materialize(docs.select(own, F.col("doc_id").cast("long").alias("id")).distinct())
    groups = ngram_jaccard.jaccard_components(docs.select(own, "text"), k=5, num=4, den=5, id_col="own")
    groups = materialize(groups.select("own", "component_id").distinct())
    first = F.min(F.struct(F.col("id").isNull(), "id", "own")).getField("own").alias("kept")
    stays = materialize(keyed.join(groups, "own").groupBy("component_id").agg(first).select("kept"))
    held = docs.select(F.xxhash64("doc_id", "text").alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = held.join(stays, held["own"] == stays["kept"], "left_semi").dropDuplicates(["own"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows. Null texts stay null, repeated rows are masked alike."""
    textkit.bound_batches(spark)
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: sources weigh 3, 1, 2, repeating. Texts without words go."""
    return mixing.repeat_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the number of characters that decode from them."""
    textkit.bound_batches(spark)
    out = bpe.encode_documents(docs, bpe.default_path())
    return out.select("doc_id", "n_tokens", "ids", F.length("decoded").cast("long").alias("decoded_chars"))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
