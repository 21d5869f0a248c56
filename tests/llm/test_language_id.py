import random

import pytest

from commstream.llm import language_id as li

KIND = "doc_id long, text string, lang string, source string, id string, score int"
ALPHABETS = {"ab": "abcde", "vw": "vwxyz", "mn": "mnopq", "éß": "éßüöä"}


def prose(lang, rng, n=60):
    return " ".join("".join(rng.choices(ALPHABETS[lang], k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    langs = list(ALPHABETS)
    return spark.createDataFrame([(i, prose(langs[i % 4], rng), langs[i % 4], "s", "x", 1) for i in range(400)], KIND)


def test_held_out_accuracy(spark, docs):
    model = li.train(docs.where(~li.held_out(docs["doc_id"], 4, 2)))
    out = docs.join(li.identify(docs, model).withColumnRenamed("score", "p"), "doc_id").where(li.held_out(docs["doc_id"], 4, 2)).collect()
    assert len(out) > 60 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["p"] <= 1 for r in out)


def test_texts_without_letters_are_undetermined(spark, docs):
    texts = [None, "", "12 34", "² ½ ①", "++ -- 5", "é", "中", "x" * 2_000_000]
    rows = spark.createDataFrame([(i, t, "ab", "", "x", 1) for i, t in enumerate(texts)] + [(None, "abc", "ab", "", "x", 1)] * 2, KIND)
    out = {}
    for r in li.identify(rows, li.train(docs)).collect():
        out.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert [out[i] == ["und"] for i in range(8)] == [True] * 5 + [False] * 3
    assert len(out[None]) == 2 and out[None][0] == out[None][1]


def test_every_language_is_learned(spark):
    """No class goes, however many there are."""
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 20, f"l{i:03}", "", "x", 1) for i in range(350)]
    model = li.train(spark.createDataFrame(rows, KIND))
    assert len(model.languages) == 350 and model.filters == li.MOST_FILTERS


def test_reruns_learn_the_same(spark, docs):
    repeated = docs.unionByName(docs).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "id", "score")
    a, b = li.train(repeated), li.train(repeated.repartition(5))
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_stage_rejects_noise_and_keeps_prose(spark, docs):
    rng = random.Random(77)
    clean = [(1000 + i, prose(list(ALPHABETS)[i % 4], rng), None, "", "x", 1) for i in range(100)]
    junk = [(2000 + i, t, None, "", "x", 1) for i, t in enumerate(li.noise(100, seed=123))]
    model = li.train(docs, noise_rows=400)
    kept = [r["doc_id"] for r in li.keep_identified(spark.createDataFrame(clean + junk, KIND), model, 0.3).collect()]
    assert sum(i < 2000 for i in kept) == 100
    assert sum(i >= 2000 for i in kept) <= 10


def test_without_labels_documents_stay(spark):
    rows = spark.createDataFrame([(1, "some text", None, "", "x", 1), (2, "1 2 3", None, "", "x", 1), (3, None, None, "", "x", 1)], KIND)
    assert li.train(rows) is None
    assert [r["doc_id"] for r in li.keep_identified(rows, None, 0.3).collect()] == [1]
    assert {r["lang_pred"] for r in li.identify(rows, None).collect()} == {"und"}
    empty = rows.limit(0)
    assert li.identify(empty, None).count() == li.keep_identified(empty, None, 0.3).count() == 0
