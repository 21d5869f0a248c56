import numpy as np
import pytest

from commstream.llm import embedding_dedup as ed

KIND = "vec_id long, embedding array<double>, id string, keys int, g string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, "y") for i, v in rows], KIND)


def truth(x):
    """n_links and component of each vector, from all pairs."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(x)).min(1))
        if (new == label).all():
            return near, label
        label = new


def turned(rng, v, cosine):
    """A vector at this cosine to v."""
    w = rng.normal(size=len(v))
    u = v / np.linalg.norm(v)
    w -= (w @ u) * u
    return cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


@pytest.mark.parametrize("d", [32, 96])
def test_recall_of_planted_pairs(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(4000, d))
    x[2000:] = [turned(rng, x[i], rng.uniform(0.901, 0.95)) for i in range(2000)]
    near, label = truth(x)
    out = {r["vec_id"]: r for r in ed.near_vectors(frame(spark, list(enumerate(x)))).collect()}
    links = np.array([out[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(1)).all()  # none below the threshold
    recall = links.sum() / near.sum()
    assert recall >= 0.9, recall
    found = links == near.sum(1)
    for i in np.flatnonzero(found & (label == np.arange(len(x)))).tolist():
        assert out[i]["component_id"] == i and out[i]["kept"]
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in range(len(x)))


def test_hot_groups_and_small_blocks(spark, monkeypatch):
    """Near copies fill buckets beyond a block; copies are one node."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=24)
    x = np.vstack([base + rng.normal(size=(500, 24)) * 0.02, np.repeat(base[None], 300, 0), rng.normal(size=(200, 24))])
    monkeypatch.setattr(ed, "BLOCK", 64)
    near, label = truth(x)
    out = {r["vec_id"]: r for r in ed.near_vectors(frame(spark, list(enumerate(x)))).collect()}
    assert [out[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [out[i]["component_id"] for i in range(len(x))] == label.tolist()


def test_estimates_are_unbiased_and_bounds_hold():
    rng, d = np.random.default_rng(9), 64
    x = rng.normal(size=(600, d))
    x[300:] = [turned(rng, v, 0.9) for v in x[:300]]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    code, factor, coarse, scale = ed.codes(unit, np.arange(600))
    signs = np.unpackbits(code, axis=1, count=d) * 2.0 - 1
    estimate = (signs @ (coarse * scale[:, None]).T) / (np.sqrt(d) * factor[:, None])
    error = estimate - unit @ unit.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 0.002 and abs(error[np.arange(300), np.arange(300, 600)].mean()) < 0.01
    may = ed.undecided(code, factor, coarse, scale, 0.9, slice(0, 600))
    true = unit @ unit.T >= 0.9
    assert may[true].all() and may.mean() < 0.05


def test_hard_rows(spark):
    bad = [None, [], [0.0] * 4, [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [None, 1, 1, 1], [1.0]]
    rows = [(100 + i, v) for i, v in enumerate(bad)] + [(1, [1, 0, 0, 0]), (1, [1, 0.1, 0, 0]), (2, [1e300, 0, 0, 0]), (3, [1e-300, 0, 0, 0]), (None, [1, 0, 0, 0]), (4, [0, 0, 0, 1])]
    out = ed.near_vectors(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in out if (r["vec_id"] or 0) >= 100 or r["vec_id"] == 4)
    assert {r["component_id"] for r in out if r["vec_id"] in (1, 2, 3)} == {1}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is None] == [(0, None, False)]
    assert ed.near_vectors(frame(spark, [])).count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[250:] = x[:50] * 2 + rng.normal(size=(50, 16)) * 0.1
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    near, label = truth(x.astype(np.float32).astype(float))
    out = {r["vec_id"]: r for r in ed.op7_embedding_dedup(spark, str(tmp_path)).collect()}
    assert sum(out[i]["n_links"] == near.sum(1)[i] for i in range(300)) >= 297
    assert sum(out[i]["component_id"] == label[i] for i in range(300)) >= 297
