import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from commstream.llm import language_id, pii, quality, simhash, substring_dedup, textkit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h string"


def frame(spark, texts, **columns):
    """Documents with extra columns whose names clash with internal ones."""
    rows = [(i if i >= 0 else None, t, columns.get("lang", "en"), columns.get("source", "a"), len(t or ""), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


EDGE = [(0, None), (1, ""), (2, "  \n"), (3, "a"), (3, "a"), (-1, "b c"), (4, "x" * 300_000)]


def test_substrings_against_brute_force(spark):
    shared = words(30, 1)
    texts = [*EDGE, (7, f"{words(9, 2)} {shared} {words(5, 3)}"), (8, f"{shared} {shared} {words(40, 4)}"), (9, "z " * 60)]
    out = {}
    for r in substring_dedup.remove_repeats(frame(spark, texts)).collect():
        out.setdefault(r["doc_id"], r)
    seen = set()
    for i, t in [x for x in texts if x[0] >= 0]:
        w, now = re.findall(r"[^\x20\x09-\x0D]+", t or ""), []
        gone = set()
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone.update(range(a, a + 20))
            seen.add(k)
        assert (out[i]["n_words"], out[i]["kept"]) == (len(w), " ".join(x for j, x in enumerate(w) if j not in gone)), now


def test_windows_need_both_hashes():
    text = words(30, 1)
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = textkit.word_spans(data, np.array([0, len(data)]))
    own = textkit.word_hashes(data, starts, ends)
    first, second = int(textkit.run_hashes(own, 20)[3].view(np.int64)), int(substring_dedup._second(own, 20)[3].view(np.int64))
    kind = pa.list_(pa.struct([("h", pa.int64()), ("check", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("ref", pa.int64()), ("at", pa.int32())]))
    gone = []
    for check in (second, second + 1):
        row = {"h": first, "check": check, "pos": 3, "n": 1, "ref": 0, "at": 0}
        batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([text]), pa.array([[row]], kind)], names=["key", "text", "rows"])
        gone.append(next(substring_dedup._remove(20, True)([batch])).column(2).to_pylist())
    assert gone == [[20], [0]]


def test_a_passage_of_most_documents_goes_from_all_but_the_first(spark):
    shared = words(24, 1)
    texts = [(i, f"{words(6, 10 + i)} {shared} {words(6, 9000 + i)}") for i in range(600)]
    out = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    seen, expected = set(), {}
    for i, t in texts:
        w, gone = t.split(), set()
        for a in range(len(w) - 19):
            if tuple(w[a : a + 20]) in seen:
                gone.update(range(a, a + 20))
            seen.add(tuple(w[a : a + 20]))
        expected[i] = (len(w), len(gone))
    assert out == expected and out[0][1] == 0 and min(n for i, (_, n) in out.items() if i) == 24
    none = substring_dedup.remove_repeats(frame(spark, texts).where("doc_id < 0"))
    assert none.columns == ["doc_id", "n_words", "n_removed", "n_factors", "spans", "kept"] and none.isEmpty()


def test_factors_break_where_the_reference_does():
    assert substring_dedup.parse(np.array([0, 1, 5]), np.array([3, 3, 3]), np.array([7, 8, 2]), 20) == [(0, 21), (5, 20)]


def test_pii_base_and_linked_mentions(spark):
    base, spans = pii.find("call +1 (724) 555-7058 now, later (724) 555-7058; on 2020-10-11 also 999 123 4567")
    assert len(base) == 1 and [k for _, _, k in spans] == [3, 3]
    assert pii.find("only (724) 555-7058 here")[1] == []
    assert pii.mask("mail bob.42@x.com or 1.2.3.4") == "mail [EMAIL] or [IP]"
    assert pii.find_pii(frame(spark, EDGE)).where("n_email = 0 and spans = ''").count() == len(EDGE)


def test_language_and_quality_learn(spark):
    rng = random.Random(4)
    made = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(60))
    rows = [(i, made("abcde" if i % 2 else "vwxyz"), "ab" if i % 2 else "vw", "", 0, "", "") for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, None, "", 0, "", ""), (901, "12 34", "ab", "", 0, "", "")], DOCS)
    out = {r["doc_id"]: r for r in language_id.identify(df, language_id.train(df)).collect()}
    assert sum(out[i]["lang_pred"] == r[2] for i, r in enumerate(rows)) >= 195
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und"
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    texts = spark.createDataFrame([(i, words(50, i) if i % 2 else "same same | " * 20, "", "", 0, "", "") for i in range(200)], DOCS)
    scores = quality.score_quality(texts, quality.train(texts, labels)).where((F.col("score") >= 0.5) == (F.col("doc_id") % 2 == 1)).count()
    assert scores >= 195


def test_fingerprints_and_tables(spark):
    texts = [(1, words(80)), (2, words(80)), (3, words(79, 0) + " extra"), (4, words(80, 9)), (5, None), (6, "")]
    prints = simhash.fingerprint_documents(frame(spark, texts))
    out = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    assert out[1] == out[2] and out[5] == out[6] == "0" * 32
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_fingerprints(prints, radius=3).collect()}
    value = {i: int(x, 16) for i, x in out.items()}
    for a in value:
        for b in value:
            if (value[a] ^ value[b]).bit_count() <= 3:
                assert near[a] == near[b]


@pytest.mark.parametrize("most", [2048, 7])
def test_near_fingerprints_against_brute_force(spark, most):
    rng, values = random.Random(6), []
    for _ in range(12):
        base = rng.getrandbits(128)
        for _ in range(20):
            values.append(base ^ sum(1 << b for b in rng.sample(range(128), rng.choice([0, 1, 6, 9, 12, 20]))))
    prints = spark.createDataFrame([(i, f"{v:032x}") for i, v in enumerate(values)], "doc_id long, fingerprint string")
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_fingerprints(prints, most=most).collect()}
    root = list(range(len(values)))
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 16 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if x == hi else x for x in root]
    assert [near[i] for i in range(len(values))] == root


def test_simhash_query_finds_near_copies_of_all_documents(spark, tmp_path):
    base = words(400).split()
    texts = [(1, " ".join(base)), (2, words(400, 1)), (3, " ".join(base[:200] + ["other"] + base[201:])), (4, words(400, 1)), (5, words(400, 2)), (-1, " ".join(base))]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in simhash.op10_simhash(spark, str(tmp_path)).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, None: 1}
    assert {i: r["class_id"] for i, r in out.items()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5, None: 1}


def test_pii_evidence_reaches_all_mentions_of_a_long_document():
    gap = " and then some more words follow here until the number is told again, "
    text = "call +1 (724) 555-7058" + gap + gap.join(["(724) 555-7058"] * 100)
    assert [k for _, _, k in pii.find(text)[1]] == [3] * 101
    assert "555" not in pii.mask(gap.join(["(724) 555-7058"] * 100) + gap + "call +1 (724) 555-7058")


def test_pii_long_runs_are_cut_at_known_numbers():
    text = "call +1 (724) 555-7058 or any of these: 724 555 7058 724 555 7058 (724) 555-7058 11 22"
    found = pii.find(text)[1]
    assert [text[a:b] for a, b, _ in found] == ["+1 (724) 555-7058", "724 555 7058", "724 555 7058", "(724) 555-7058"]
    assert pii.number_pieces("1234 5678 9012 3456 7890 1234", 0, 29, set()) == [(0, 19), (20, 29)]
