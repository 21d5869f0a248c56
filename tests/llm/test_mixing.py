import random

import duckdb
import numpy as np

from commstream.llm import mixing

KIND = "doc_id long, text string, source string, size int, class string, s string, copies int, row string, u double"


def made(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, s, 777, "c", "s", 5, "r", 0.5) for i, t, s in rows], KIND)


def test_inclusion_frequencies_are_the_stated_probabilities(spark):
    """400 sources of the same sizes are 400 independent draws."""
    rng = random.Random(2)
    sizes = [rng.randint(1, 60) for _ in range(30)] + [rng.randint(100, 400) for _ in range(30)]
    rows = [(k * 100 + i, "w " * n, f"s{k}") for k in range(400) for i, n in enumerate(sizes)]
    out = mixing.mix(made(spark, rows), weights=(1.0,), share=0.7).toPandas().sort_values("doc_id")
    copies = out["copies"].to_numpy().reshape(400, 60)
    expected = out["expected"].to_numpy().reshape(400, 60)
    assert np.ptp(expected, axis=0).max() < 1e-9 and np.ptp(expected[0]) > 0.3  # unequal from document to document
    error = np.sqrt(np.maximum(expected[0] % 1 * (1 - expected[0] % 1), 0.01) / 400)
    assert (np.abs(copies.mean(0) - expected[0]) / error).max() < 5
    assert np.isin(copies - np.floor(expected), (0, 1)).all()
    taken = (copies * np.array(sizes)).sum(1)
    assert np.abs(taken / out["target"].iloc[0] - 1).max() < 0.02


def test_ranks_follow_the_inclusion_odds(spark):
    """Within a class of one sample, halving the inclusion odds doubles the rank."""
    rows = spark.createDataFrame([(0.5, 0.2), (0.5, 0.5), (0.9, 0.5)], "u double, f double").select(mixing._rank().alias("r")).collect()
    assert np.allclose([r["r"] for r in rows], [4.0, 1.0, 9.0])


def test_mix_equals_its_sql_on_hard_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "w\t" * rng.choice([1, 3, 17, 250]), None if i % 9 == 0 else f"s{min(i % 7, 3)}") for i in range(500)]
    rows += [(900, None, "s1"), (901, "", "s1"), (902, " \n", None), (903, "v " * 30_000, "s2"), (None, "no id", "s1"), (None, "no id at all", "s1"), (905, None, "only empty"), (906, "one", "only one")]
    rows += [(i, "copy of one text", "s0") for i in range(2000, 2300)]
    df = made(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    own = mixing.op4_mixing(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.sql(mixing.ORACLE_SQL).df()
    key = lambda x: sorted(map(tuple, x[["doc_id", "size", "source_size", "target", "taken"]].fillna(-1).to_numpy().tolist()))
    assert key(own) == key(told)
    assert (own["taken"] <= 2 * own["size"]).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert sorted(again["taken"]) == sorted(own["taken"])


def test_repeated_documents_keep_every_column(spark):
    rows = [(i, f"word{i} " * (1 + i % 20), f"s{i % 3}") for i in range(200)] + [(7, "word7 " * 8, "s1"), (None, None, None)]
    df = made(spark, rows)
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    found = out.collect()
    assert {(r["size"], r["class"], r["s"], r["copies"], r["row"], r["u"]) for r in found} == {(777, "c", "s", 5, "r", 0.5)}
    copies = mixing.mix(df).toPandas()
    assert len(found) == copies["copies"].sum()


def test_empty_table(spark):
    empty = made(spark, [])
    assert mixing.mix(empty).count() == mixing.repeat_documents(empty).count() == 0
