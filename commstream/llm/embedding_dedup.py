"""Embedding near-dedup with randomised-rotation binary codes.

A vector is turned by a random rotation. Its code, computed once and stored, is the signs of the result in packed
bits; its correction factor the inner product of code and vector, both of unit length; beside them stand the turned
vector's coordinates in 8 bits, rounded at random. With the factor, the inner product of a code and another turned
vector is an unbiased estimate of the cosine, with an error of about sqrt((1 - f^2) / f^2 / (d - 1)). Pairs whose
estimate plus BOUND such errors stays below the threshold, from either side, are dropped on codes alone. Vectors are
fetched for the rows of the pairs that are left, and these are computed exactly in double precision.

Pairs meet in buckets: TABLES keys of signs under further rotations, so many bits each that a bucket holds some dozen
rows. Two vectors at cosine 0.9 share some key with probability 0.95 or more at the key lengths used, nearer ones
almost surely. Equal vectors are one row. Buckets beyond BLOCK rows are compared block by block.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.llm import skew
from commstream.llm import textkit as tk
from commstream.operators.components import connected_components
from commstream.storage import materialize

BOUND = 4.0
ROUNDING = 0.02  # more than 8-bit coordinates shift an estimate by
BLOCK = 4096
ROWS_IN_BUCKET = 64
RECALL = 0.95
MAX_BITS = 30
STRIPE = 256


@functools.lru_cache(64)
def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def key_shape(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables: buckets hold few rows, a pair at the threshold meets with this chance."""
    bits = min(MAX_BITS, max(4, math.ceil(math.log2(max(2, rows) / ROWS_IN_BUCKET))))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def sign_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key for each row and table, from signs under as many rotations as it takes."""
    d = unit.shape[1]
    signs = [unit @ rotation(d, 101 + i) > 0 for i in range(-(-bits * tables // d))]
    signs = np.hstack(signs)[:, : bits * tables].reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def codes(unit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign codes, correction factors, coordinates of the turned rows in 8 bits, and the unit of these."""
    turned = unit @ rotation(unit.shape[1], 7)
    factor = np.abs(turned).sum(1) / math.sqrt(unit.shape[1])
    scale = np.abs(turned).max(1) / 127
    draws = tk.mix(ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(unit.shape[1], dtype=np.uint64))
    coarse = np.floor(turned / scale[:, None] + (draws >> np.uint64(11)) / float(1 << 53))
    return np.packbits(turned > 0, axis=1), factor, np.clip(coarse, -127, 127).astype(np.int8), scale


def undecided(code: np.ndarray, factor: np.ndarray, coarse: np.ndarray, scale: np.ndarray, threshold: float, rows: slice) -> np.ndarray:
    """For some rows against all: whether the bounds of both estimates reach the threshold."""
    d = coarse.shape[1]
    signs = np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1
    turned = coarse.astype(np.float32) * scale[:, None].astype(np.float32)
    by = (1 / (factor * math.sqrt(d))).astype(np.float32)
    bound = BOUND * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(1, d - 1)) + ROUNDING
    one = (signs[rows] @ turned.T) * by[rows, None] + bound[rows, None] >= threshold
    return one & ((turned[rows] @ signs.T) * by[None] + bound[None] >= threshold)


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clean(batches):
    """key and the vector as bytes of doubles; null where it cannot link."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            ok = len(x) and np.isfinite(x).all() and x.any()
            x = x / np.abs(x).max() if ok else x  # so that no square overflows; the angle stays
            out.append((x + 0.0).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "vector"])


def _coded(bits: int, tables: int):
    """id, d, keys of all tables, and the code with its factor, coordinates and their unit: once for each vector."""

    def run(batches):
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for size in sorted({len(r) for r in raw}):
                rows = [i for i, r in enumerate(raw) if len(r) == size]
                for part in (np.array(rows[i : i + 512]) for i in range(0, len(rows), 512)):
                    unit = _units([raw[i] for i in part])
                    keys = sign_keys(unit, bits, tables)
                    code, factor, coarse, scale = codes(unit, ids[part])
                    packed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(np.full(len(part), size // 8)), keys, packed(code), pa.array(factor), packed(coarse), pa.array(scale)], names=["id", "d", "keys", "code", "factor", "coarse", "scale"])

    return run


def _groups(batches, columns: int):
    """The rows of each group, given in a row: lists of columns; one group and one batch are held."""
    kept: list[list] = [[] for _ in range(columns)]
    for batch in batches:
        own = [c.to_pylist() if pa.types.is_binary(c.type) or pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        g = own[0]
        if not len(g):
            continue
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if kept[0] and kept[0][-1] != g[a]:
                yield kept
                kept = [[] for _ in range(columns)]
            for held, x in zip(kept, own, strict=True):
                held.extend(x[a:b])
    if kept[0]:
        yield kept


def _open_rows(threshold: float):
    """g, t, id, blk, cross of the rows of a group that are in a pair which codes leave undecided."""

    def run(batches):
        out: list[list] = [[] for _ in range(5)]
        for g, t, ids, blk, cross, d, code, factor, coarse, scale in _groups(batches, 10):
            if len(g) < 2:
                continue
            n, d = len(g), int(d[0])
            code, coarse = np.frombuffer(b"".join(code), np.uint8).reshape(n, -1), np.frombuffer(b"".join(coarse), np.int8).reshape(n, d)
            factor, scale, block = np.array(factor), np.array(scale), np.array(blk)
            for a in range(0, n, STRIPE):
                rows = slice(a, min(n, a + STRIPE))
                may = undecided(code, factor, coarse, scale, threshold, rows)
                may[np.arange(rows.stop - a), np.arange(a, rows.stop)] = False
                if cross[0]:
                    may &= block[rows, None] != block[None]
                for i in (np.flatnonzero(may.any(1)) + a).tolist():
                    for held, x in zip(out, (g, t, ids, blk, cross), strict=True):
                        held.append(x[i])
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, _OPEN, strict=True)], names=["g", "t", "id", "blk", "cross"])
                out = [[] for _ in range(5)]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, _OPEN, strict=True)], names=["g", "t", "id", "blk", "cross"])

    return run


_OPEN = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())


def exact_links(unit: np.ndarray, block: np.ndarray, cross: bool, keys: np.ndarray, table: int, threshold: float) -> np.ndarray:
    """Which rows link, by exact cosines, and met in no earlier table."""
    n = len(unit)
    links = np.zeros((n, n), bool)
    for a in range(0, n, STRIPE):
        own = links[a : a + STRIPE]
        np.greater_equal(unit[a : a + STRIPE] @ unit.T, threshold, out=own)
        own[np.arange(len(own)), np.arange(a, a + len(own))] = False
        if cross:
            own &= block[a : a + STRIPE, None] != block[None]
        for t in range(table if own.any() else 0):
            own &= keys[a : a + STRIPE, t, None] != keys[None, :, t]
    return links


def roots(links: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked with, directly or not."""
    label = np.arange(len(links))
    while True:
        new = label.copy()
        for a in range(0, len(links), STRIPE):
            low = np.where(links[a : a + STRIPE], label[None], len(links)).min(1)
            new[a : a + STRIPE] = np.minimum(new[a : a + STRIPE], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            return label
        label = new


def _recomputed(threshold: float):
    """(id, links, other): links a row has in a group; and rows with links 0 for the connections."""

    def run(batches):
        for _, t, ids, blk, cross, n, vectors, keys in _groups(batches, 8):
            if len(ids) < 2:
                continue
            links = exact_links(_units(vectors), np.array(blk), bool(cross[0]), np.array(keys), int(t[0]), threshold)
            count = np.concatenate([links[a : a + STRIPE] @ np.array(n, np.float64) for a in range(0, len(ids), STRIPE)]).astype(np.int64)
            some = np.flatnonzero(count)
            if not len(some):
                continue
            ids, root = np.array(ids), roots(links)
            tree = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((ids[some], ids[tree]), (count[some], np.zeros(len(tree), np.int64)), (ids[some], ids[root[tree]]))], names=["id", "links", "other"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for each row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different dimensions,
    link with nothing. A cosine at the threshold (tie) links. Null ids keep their row, with no link and kept false;
    rows that repeat an id are one node, linked with itself by no link but counted as rows by others. Long vectors
    are taken whole. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_clean, "key long, vector binary"))
    usable = rows.where("vector is not null")
    classes = materialize(usable.groupBy("vector").agg(F.min("key").alias("rep"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    bits, tables = key_shape(classes.count(), threshold)
    coded = materialize(classes.select("id", "vector").mapInArrow(_coded(bits, tables), "id long, d long, keys array<long>, code binary, factor double, coarse binary, scale double"))
    dealt = coded.select("id", "d", F.posexplode("keys").alias("t", "key"))
    large = materialize(dealt.groupBy("t", "key", "d").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows"))
    placed = coded.select("id", "d", "code", "factor", "coarse", "scale", F.posexplode("keys").alias("t", "key"))
    # A large bucket holds BLOCK rows or more, so there are few; each block meets every other one in a group of their own.
    placed = placed.join(F.broadcast(large), ["t", "key", "d"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long")).withColumn("to", F.explode(F.expr("sequence(0L, cast(blocks - 1 as long))")))
    low, high = F.least("blk", "to"), F.greatest("blk", "to")
    grouped = placed.select(F.xxhash64("t", "key", "d", low, high).alias("g"), F.col("t").cast("long").alias("t"), "id", "blk", (low != high).alias("cross"), "d", "code", "factor", "coarse", "scale")
    left = materialize(grouped.repartition("g").sortWithinPartitions("g").mapInArrow(tk.released(_open_rows(threshold)), "g long, t long, id long, blk long, cross boolean"))
    fetched = left.join(classes.select("id", "n", "vector"), "id").join(coded.select("id", "keys"), "id").select("g", "t", "id", "blk", "cross", "n", "vector", "keys")
    found = materialize(fetched.repartition("g").sortWithinPartitions("g").mapInArrow(tk.released(_recomputed(threshold)), "id long, links long, other long"))
    counts = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("links = 0").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("v", "id")
    near = classes.join(counts, "id", "left").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    near = materialize(near.select("vector", "rep", "n", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    near = near.join(near.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("vector", "n", "n_links", "component_id")
    near = materialize(near)
    many = near.where(F.col("n") >= skew.hot_rows(rows.count())).drop("n")
    linked = skew.join_by_key(usable, near.drop("n"), ["vector"], many).select("key", "n_links", "component_id")
    alone = rows.where("vector is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = linked.unionByName(alone).select(F.col("key").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.withColumn("kept", F.col(id_col) == F.col("component_id"))
    unnamed = vectors.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept"))
    return out.unionByName(unnamed)


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near vectors among all embeddings at cosine 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
