import random
import re
import time

import pytest

from commstream.llm import pii

KINDS = ("email", "ip", "card", "phone")


def plain_spans(text):
    """The base patterns by plain regexes, no shortcuts."""
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (724) 555-7058", "+", "0", " ", "  ", "-", ".", "é", "99", "١٢"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(4000)]
    texts += [pii._written(rng)[0] for _ in range(300)]
    for text in texts:
        base, spans = pii.find(text)
        assert base == plain_spans(text), text
        assert set(base) <= set(spans)


def test_the_field_decides_on_planted_documents():
    """True and false spans that the field adds beside the base ones, in documents it was not trained on."""
    rng, true, false, hit, without = random.Random(99), 0, 0, 0, 0
    for _ in range(600):
        text, pieces = pii._written(rng)
        at, where = 0, []
        for piece, label in pieces:
            at = text.index(piece, at)
            where.append((at, at + len(piece), label))
            at += len(piece)
        base, spans = pii.find(text)
        alone = pii.find(text, use_skips=False)[1]
        without += alone != spans
        own = set(spans) - set(base)
        hidden = [(a, b, label) for a, b, label in where if label and not any(a < e and s < b for s, e, _ in base)]
        good = [x for x in hidden if any(x[0] < e and s < x[1] and k + 1 == x[2] for s, e, k in own)]
        true, hit = true + len(hidden), hit + len(good)
        false += sum(not any(a < e and s < b for a, b, label in where if label) for s, e, _ in own)
    assert true > 500 and hit >= 0.8 * true, (true, hit, false)
    assert false <= 0.05 * hit, (true, hit, false)
    assert without > 50  # documents where the skip edges change the spans


def test_skip_edges_carry_the_evidence():
    text = "call +1 (724) 555-7058" + " and so on with many words of no weight at all" * 3 + " 724 555 7058 once more"
    assert [k for _, _, k in pii.find(text)[1]] == [3, 3]
    assert [k for _, _, k in pii.find(text, use_skips=False)[1]] == [3]


def test_addresses_that_are_only_written_out():
    assert [k for _, _, k in pii.find("mail bob.42 (at) x.com and bob.42 (at) x.com")[1]] == [0, 0]
    assert pii.find("he was [at] home")[1] == []


@pytest.mark.parametrize("text", ["x" * 1_000_000 + " 12345678 @", "x" * 500_000 + "@" + "y" * 500_000, "+1 " * 300_000, "0" * 1_000_000 + ".1.1.1 12345678 9", "12345678 " * 20_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 20


def test_tables(spark):
    kind = "doc_id long, text string, id string, spans int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "a@b.cd", "x", 1), (3, "a@b.cd", "x", 1), (None, "1.2.3.4", "x", 1)]
    df = spark.createDataFrame(rows, kind)
    out = sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["spans"]) for r in pii.find_pii(df).collect())
    assert out == [(0, 0, 1, "ip:0:7"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:0:6"), (3, 1, 0, "email:0:6")]
    masked = pii.mask_pii(df)
    assert masked.columns == df.columns
    assert sorted(str(r["text"]) for r in masked.collect()) == ["", "None", "[EMAIL]", "[EMAIL]", "[IP]"]
    empty = spark.createDataFrame([], kind)
    assert pii.find_pii(empty).count() == pii.mask_pii(empty).count() == 0


def test_query_over_a_whole_table(spark, tmp_path):
    import hashlib

    rng = random.Random(12)
    texts = [pii._written(rng)[0] for _ in range(60)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        spans = plain_spans(text or "")
        told = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)
        assert out[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in KINDS] == [sum(x == k for _, _, x in spans) for k in range(4)]
