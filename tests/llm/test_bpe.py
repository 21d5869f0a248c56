import random
import time

import pytest
from tokenizers import Tokenizer

from commstream.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(bpe.default_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def same(vocabulary, library, texts):
    for text, (ids, n, decoded) in zip(texts, vocabulary.encode_texts(texts), strict=True):
        own = library.encode(text, add_special_tokens=False).ids
        assert (ids, n, decoded) == (" ".join(map(str, own)), len(own), library.decode(own, skip_special_tokens=False)), ascii(text)


def test_equals_the_library(vocabulary, library):
    rng = random.Random(1)
    texts = ["", "<|endoftext|>x<|startoftext|> Y", "don't I'LL", "a" * 3000, "ΑΣ İ é", "\x1c a", "a\x1cb é", "é\x85\xa0b", "word " * 50]
    texts += ["".join(rng.choices("abcdeéß'<|>endoftxr .,1́中", k=rng.randint(0, 40))) for _ in range(2000)]
    same(vocabulary, library, texts)


def test_every_code_point(vocabulary, library):
    """Each one between letters, after a number, and alone."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c in range(0xE0000, 0xE0200) or c % 4099 == 0)]
    same(vocabulary, library, [f"a{c}b 1{c} {c}" for c in points])


def test_random_unicode(vocabulary, library):
    rng = random.Random(7)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x590), (0x590, 0x1000), (0x1C80, 0x2100), (0x2000, 0x2C00), (0x3000, 0x3100), (0xA640, 0xAB70), (0x10000, 0x11FFF), (0x1F300, 0x1FAFF)]
    same(vocabulary, library, ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(1, 25))) for _ in range(20_000)])


def test_rows(spark):
    kind = "doc_id long, text string, id string, ids int, decoded string"
    rows = [(0, None, "x", 1, ""), (1, "", "x", 1, ""), (2, " \n", "x", 1, ""), (3, "a", "x", 1, ""), (3, "a", "x", 1, ""), (None, "b c", "x", 1, ""), (4, "x" * 300_000, "x", 1, "")]
    out = bpe.encode_documents(spark.createDataFrame(rows, kind), bpe.default_path()).collect()
    assert len(out) == len(rows) and all(len(r["ids"]) == r["n_tokens"] for r in out)
    assert [r["n_tokens"] for r in out if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]
    assert bpe.encode_documents(spark.createDataFrame([], kind), bpe.default_path()).count() == 0


def test_long_words_take_little_more_than_linear_time(vocabulary):
    began = time.time()
    vocabulary.encode_texts(["ab" * 500_000])
    assert time.time() - began < 120


def test_new_chunks_are_cut_in_one_go():
    """A search for each of them took most of the time of texts with many rare words."""
    own, calls = bpe.Bpe(bpe.default_path()), []

    class Counted:
        def findall(self, text, pieces=own.pieces):
            calls.append(text)
            return pieces.findall(text)

    own.pieces = Counted()
    own.encode_texts([" ".join(f"a{i}." for i in range(1000))])
    assert len(calls) == 1 and len(own.ids_of) == 1000
