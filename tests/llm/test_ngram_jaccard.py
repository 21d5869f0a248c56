import random
import re

import numpy as np
import pytest

from commstream.llm import ngram_jaccard as nj

KIND = "doc_id long, text string, key string, v int, n string, rep string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], KIND)


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows, k, num, den):
    """By row: set size and component, from all pairs; rows with one id are linked."""
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            near = sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
            if near or (rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), 1 << 62), 1 << 62 if i is None else i)
    return [(i, len(sets[a]), (None if least[find(a)] == 1 << 62 else least[find(a)]) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def noisy(base, rng, most):
    own = list(base)
    for _ in range(rng.randint(0, most)):
        own[rng.randrange(len(own))] = f"n{rng.randrange(99)}"
    return " ".join(own)


def planted(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "A"), (3, "a"), (None, "b c"), (None, "b C"), (4, "x" * 300_000), (5, "a b"), (6, "b a")]
    bases = [words(n, 100 + n).split() for n in (12, 60, 61, 300)]
    rows += [(10 + i, noisy(rng.choice(bases), rng, 4)) for i in range(70)]
    rows += [(100 + i, " ".join(bases[1])) for i in range(20)]  # copies
    rows += [(200 + i % 8, noisy(rng.choice(bases), rng, 3)) for i in range(24)]  # one id, different texts
    rows += [(None, noisy(bases[1], rng, 2)) for _ in range(3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5)])
def test_components_against_all_pairs(spark, k, num, den):
    rows = planted(k)
    out = nj.jaccard_components(frame(spark, rows), k, num, den).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == sorted(expected(rows, k, num, den), key=key)


@pytest.mark.parametrize("columns", [1, 7, 64, 5000])
def test_products_are_exact_or_below_the_bound(columns):
    rng = np.random.default_rng(columns)
    for _ in range(60):
        universe = np.sort(rng.integers(0, 1 << 63, rng.integers(3, 300), dtype=np.uint64) * np.uint64(2))
        rows = [np.sort(rng.choice(universe, rng.integers(1, len(universe) + 1), replace=False)) for _ in range(8)]
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows[1:]])])
        got = nj.overlap_counts(rows[0], np.concatenate(rows[1:]), first, 4, 5, columns)
        for r, count in zip(rows[1:], got, strict=True):
            true = len(np.intersect1d(rows[0], r))
            assert count == true or (count == -1 and true < nj.minimum_overlap(len(rows[0]), len(r), 4, 5))


def test_hot_groups_keep_every_link(spark):
    """A large group of copies and one of near copies, blocks of few rows."""
    rng, base = random.Random(3), words(80, 9).split()
    rows = [(i, " ".join(base)) for i in range(400)] + [(1000 + i, noisy(base, rng, 1)) for i in range(300)]
    out = {r["doc_id"]: r["component_id"] for r in nj.jaccard_components(frame(spark, rows), 3, 9, 10).collect()}
    assert [out[i] for i, _ in rows] == [c for _, _, c in expected(rows, 3, 9, 10)]


def test_empty_table_and_query(spark, tmp_path):
    assert nj.jaccard_components(frame(spark, [])).count() == 0
    rows = [(i, words(30, i // 2)) for i in range(20)] + [(99, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = nj.op2_ngram_jaccard(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(expected(rows, 3, 9, 10))
