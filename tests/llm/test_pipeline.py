import collections
import random

import duckdb
from test_ngram_jaccard import expected, noisy, words
from tokenizers import Tokenizer

import corpus_pipeline as cp
from commstream.llm import bpe, language_id, mixing, pii, textkit
from commstream.storage import materialize

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, own string, w int, d int, s string, row string, copy int"
EXTRA = (777, "o", 1, 2, "s", "r", 3)


def documents(spark):
    rng, rows = random.Random(6), []
    bases = [words(n, n).split() for n in (40, 80, 90)]
    for i in range(150):
        text = noisy(bases[i % 3], rng, 2) if i % 2 else words(rng.randint(20, 90), 1000 + i)
        if i % 10 == 0:
            text += " call +1 (724) 555-7058 or mail bob.42@x.com, later (724) 555-7058"
        rows.append((i, text, ["aa", "bb", None][i % 3], [None, "s1", "s2"][i % 3 if i % 7 else 0]))
    rows += [(500 + i, t, None, "s1") for i, t in enumerate(language_id.noise(10, seed=5))]
    rows += [(600, None, "aa", "s1"), (601, "", "aa", "s1"), (602, "12 34 5", "aa", None), (603, words(20_000, 5), "aa", "s2")]
    rows += [(7, rows[7][1], "bb", "s1")] * 2 + [(8, words(50, 77), "aa", "s1")]  # a repeated row; one id with another text
    rows += [(None, words(45, 78), "aa", "s1"), (None, " ".join(bases[1]), "aa", "s1")]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), *EXTRA) for i, t, g, s in rows], KIND)


def as_rows(df):
    return collections.Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = materialize(documents(spark))
    assert [name for name, _ in cp.STAGES] == ["language_id", "ngram_jaccard", "pii", "mixing", "bpe"]

    first = materialize(cp.language_stage(spark, docs, ""))
    model = language_id.train(docs, noise_rows=cp.NOISE_ROWS)
    stays = [r for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
    judged = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    stays = [r for r in stays if r["doc_id"] is None or (judged[r["doc_id"]]["lang_pred"] != "und" and judged[r["doc_id"]]["score"] >= cp.LEAST_LANGUAGE_SCORE)]
    assert as_rows(first) == collections.Counter((r["doc_id"], r["text"], r["source"]) for r in stays)
    assert not any(500 <= (r["doc_id"] or 0) < 510 for r in first.collect()) and first.count() >= 154

    second = materialize(cp.near_duplicate_stage(spark, first, ""))
    own = [(i, r["text"]) for i, r in enumerate(first.collect())]
    ids = {i: r["doc_id"] for i, r in enumerate(first.collect())}
    groups = collections.defaultdict(list)
    for (i, _, component), (_, text) in zip(expected(own, 5, 4, 5), own, strict=True):
        groups[component].append((ids[i] is None, ids[i] or 0, text))
    kept = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert len(kept) == len(groups)
    least = sorted(min(g)[:2] for g in groups.values())
    assert sorted((i is None, i or 0) for i, _ in kept) == least

    third = materialize(cp.pii_stage(spark, second, ""))
    assert as_rows(third) == collections.Counter((r["doc_id"], pii.mask(r["text"]), r["source"]) for r in second.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in third.collect())

    fourth = materialize(cp.mixing_stage(spark, third, ""))
    third.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.sql("SELECT doc_id, CAST(sum(taken // size) AS BIGINT) AS n FROM (" + mixing.ORACLE_SQL + ") AS m WHERE size > 0 GROUP BY doc_id").fetchall()
    assert {i: n for i, n in told if n} == collections.Counter(r["doc_id"] for r in fourth.collect())
    for stage in (first, second, third, fourth):
        assert stage.columns == docs.columns
        assert {tuple(r)[5:] for r in stage.collect()} == {EXTRA}

    last = cp.encoding_stage(spark, fourth, "").collect()
    library = Tokenizer.from_file(bpe.default_path())
    ids = collections.Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in fourth.collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in last) == ids

    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    whole = cp.run(spark, f"{tmp_path}/sf").collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in whole) == ids


def test_empty_table_and_no_labels(spark):
    docs = documents(spark)
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) AS lang", "source", "n_chars")
    assert cp.language_stage(spark, unlabelled, "").count() == docs.where("text rlike '[A-Za-z]'").count() + sum(any(c.isalpha() for c in t) and not any(c.isascii() and c.isalpha() for c in t) for t in language_id.noise(10, seed=5))


def test_arrow_batches_are_bounded_unless_the_session_says_otherwise(spark):
    try:
        spark.conf.unset(textkit.BATCH_SETTING)
        textkit.bound_batches(spark)
        assert spark.conf.get(textkit.BATCH_SETTING) == str(textkit.BATCH_BYTES)
        spark.conf.set(textkit.BATCH_SETTING, "1048576")
        textkit.bound_batches(spark)
        assert spark.conf.get(textkit.BATCH_SETTING) == "1048576"
    finally:
        spark.conf.unset(textkit.BATCH_SETTING)
