"""Document fingerprints: SimHash over weighted terms, and permuted block tables for Hamming neighbours.

Terms are word pairs (weight 2) and words of six bytes or more (weight 1); texts below 24 words add all runs of four
bytes (weight 1). Each term's hash votes with its weight for every bit that it sets and against every other one; a
bit is set where the votes are positive. Repeated terms vote each time.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commstream.llm import textkit as tk
from commstream.llm.skew import free_shuffles, hot_rows, join_by_key
from commstream.operators.components import connected_components
from commstream.storage import materialize

BITS = 128
FEW_WORDS = 24
NULL_ID = -(1 << 63)
#: Of the pairs within 24 bits with similarity 0.8 (three-word shingles) 77 % in sf0.1 and 94 % in 12,000 documents of
#: check_h are so near; of pairs with less than 0.2, none and 5.
RADIUS = 16
TABLES_AT_ONCE = 17


def _votes(hashes: np.ndarray) -> np.ndarray:
    """Sum of the terms' bits: how many terms set each of the BITS bits."""
    total = np.zeros(BITS, np.int64)
    for part in range(BITS // 64):
        h = tk.mix(hashes + np.uint64(0xA5A5 + 977 * part))
        for at in range(0, len(h), 4096):
            total[64 * part : 64 * part + 64] += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return total


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """The fingerprint of each text, given in UTF-8, as BITS / 8 bytes. No term: all bits clear."""
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, first = tk.word_spans(data, offsets)
    words, long, out = tk.word_hashes(data, starts, ends, lower=True), ends - starts >= 6, []
    pairs = tk.run_hashes(words, 2)
    for i, text in enumerate(texts):
        a, b = int(first[i]), int(first[i + 1])
        own, two = words[a:b][long[a:b]], pairs[a : max(a, b - 1)]
        if b - a < FEW_WORDS:
            byte = tk.mix(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1))
            own = np.concatenate([own, tk.run_hashes(byte, min(4, len(byte))) if len(byte) else byte])
        set_by, all_terms = _votes(own) + 2 * _votes(two), len(own) + 2 * len(two)
        out.append(np.packbits(2 * set_by > all_terms).tobytes() if all_terms else bytes(BITS // 8))
    return out


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits, from 0 to 1."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def _print(batches):
    for batch in tk.slices(batches):
        done = fingerprints([(t or "").encode() for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.hex() for x in done], pa.string())], names=["id", "fingerprint"])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint as hex), a row for each row of docs, in one pass. Null counts as empty: all bits clear."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_print, "id long, fingerprint string").withColumnRenamed("id", id_col)


def block_tables(radius: int) -> list[int]:
    """Masks of the bits that a table is keyed by: radius + 2 blocks, of which prints within the radius share some two."""
    cuts = [BITS * i // (radius + 2) for i in range(radius + 3)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(parts, 2)]


def near_pairs(bucket: np.ndarray, block: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that link all prints within the radius in each bucket; bucket is sorted. Pairs that are linked already are left out.

    Of rows in different blocks (block >= 0) only pairs across blocks are compared.
    """
    n, root, found = len(bucket), np.arange(len(bucket)), []
    ends = np.searchsorted(bucket, bucket, side="right")
    left, d = np.arange(n), 0
    while len(left):
        d += 1
        left = left[left + d < ends[left]]
        i = left[(root[left] != root[left + d]) & ((block[left] < 0) | (block[left] != block[left + d]))]
        i = i[np.bitwise_count(hi[i] ^ hi[i + d]) + np.bitwise_count(lo[i] ^ lo[i + d]) <= radius]
        if len(i):
            found.append(np.stack([i, i + d]))
            a, b = root[i], root[i + d]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _compare(radius: int, most: int):
    """Links (a, b) of a task's buckets; rows of a bucket of more than ``most`` come back with their block and the number of blocks."""

    def run(batches):
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        key, block, hi, lo, v = (np.concatenate(c).astype(np.int64) for c in (zip(*held, strict=True) if held else [[np.zeros(0)]] * 5))
        order = np.lexsort((v, key))
        key, block, hi, lo, v = (x[order] for x in (key, block, hi, lo, v))
        start, size = np.searchsorted(key, key), np.searchsorted(key, key, side="right")
        size = size - start
        hot = (size > most) & (block < 0)
        few = ~hot & (size > 1)
        a, b = near_pairs(key[few], block[few], hi[few].view(np.uint64), lo[few].view(np.uint64), radius)
        own = v[few]
        at = (np.arange(len(key)) - start)[hot] // most
        blank = np.full(len(a), -1, np.int64)
        columns = [np.concatenate(x) for x in ((own[a], v[hot]), (own[b], v[hot]), (blank, key[hot]), (blank, at), (blank, (size[hot] - 1) // most + 1), (blank, hi[hot]), (blank, lo[hot]))]
        for i in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000], pa.int64()) for c in columns], names=["a", "b", "key", "block", "blocks", "hi", "lo"])

    return run


def near_classes(prints: DataFrame, radius: int = RADIUS, print_col: str = "fingerprint", id_col: str = "doc_id", most: int = 2048) -> DataFrame:
    """(print, class_id, component_id), a row for each distinct print: the smallest id that has it, and that of its linked group.

    The bits are cut into radius + 2 blocks. Two prints within the radius agree in some two of them, so a table for
    each two, keyed by those, finds every pair: nothing is missed, nothing is sampled. Equal prints are one row.
    Tables are dealt out some at a time, so that shuffles of earlier ones are gone. A bucket of more than ``most``
    prints is cut into blocks of so many, and each two blocks are a bucket of their own.
    """
    known = prints.select(F.col(id_col).cast("long").alias("id"), F.col(print_col).alias("print")).where("print is not null")
    spark = known.sparkSession
    part = lambda i: F.conv(F.substring("print", 8 * i + 1, 8), 16, 10).cast("long")
    words = [F.shiftleft(part(i), 32).bitwiseOR(part(i + 1)).alias(c) for i, c in ((0, "hi"), (2, "lo"))]
    own = known.groupBy("print").agg(F.min("id").alias("rep"))
    own = materialize(own.select("print", "rep", F.monotonically_increasing_id().alias("v"), *words))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = lambda x: (x & ((1 << 64) - 1)) - ((x >> 63 & 1) << 64)
    masks, schema = list(enumerate(block_tables(radius))), "a long, b long, key long, block long, blocks long, hi long, lo long"
    out = []
    for first in range(0, len(masks), TABLES_AT_ONCE):
        keys = [F.xxhash64(F.lit(t), F.col("hi").bitwiseAND(F.lit(signed(m >> 64))), F.col("lo").bitwiseAND(F.lit(signed(m)))) for t, m in masks[first : first + TABLES_AT_ONCE]]
        cells = own.select(F.explode(F.array(*keys)).alias("key"), F.lit(-1).cast("long").alias("block"), "hi", "lo", "v")
        out.append(materialize(cells.repartition(count, "key").mapInArrow(_compare(radius, most), schema)))
        del cells
        free_shuffles(spark)
    found = functools.reduce(DataFrame.unionByName, out)
    links, hot = found.where("blocks < 0").select("a", "b"), found.where("blocks > 0")
    if not hot.isEmpty():
        both = hot.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        # A block beside itself is compared within (block -1), beside another one across.
        cells = both.select(pair.alias("key"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.col("block")).cast("long").alias("block"), "hi", "lo", F.col("a").alias("v"))
        more = materialize(cells.repartition(count, "key").mapInArrow(_compare(radius, 1 << 62), schema))
        links = links.unionByName(more.select("a", "b"))
    comps = connected_components(links)
    placed = materialize(own.join(comps, "v", "left").select("print", "rep", F.coalesce("component", "v").alias("c")))
    least = materialize(placed.groupBy("c").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    hot = least.where(F.col("n") >= hot_rows(placed.count()))
    return materialize(join_by_key(placed, least.drop("n"), ["c"], hot).select("print", F.col("rep").alias("class_id"), "component_id"))


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", print_col: str = "fingerprint", most: int = 2048) -> DataFrame:
    """(id_col, class_id, component_id): documents by equal fingerprint and by links within the Hamming radius.

    Null ids and prints are left out.
    """
    known = prints.select(F.col(id_col).cast("long").alias("id"), F.col(print_col).alias("print")).dropna()
    placed = near_classes(known, radius, "print", "id", most)
    return known.join(placed, "print").select(F.col("id").alias(id_col), "class_id", "component_id")


def _next_ids(ids: DataFrame) -> DataFrame:
    """(key, after): the next larger id of each distinct id, the smallest after the largest; no global window."""
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(ids.distinct().repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    inner = ranged.withColumn("after", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    # One row for each partition of the range: a window over them is small however many documents there are.
    chained = firsts.withColumn("following", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy())))
    return inner.join(F.broadcast(chained), "part").select("key", F.coalesce("after", "following").alias("after"))


def _heads(batches):
    """What the document before needs of each text: its head and its fingerprint."""
    for batch in tk.slices(batches):
        texts = batch.column(1).to_pylist()
        heads = [t[:n] for t, n in zip(texts, batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string()), pa.array(fingerprints([t.encode() for t in texts]), pa.binary())], names=["key", "head", "next"])


def _edited(batches):
    """Fingerprints of a text and of the text with its tail replaced by the next text's head; likeness to that and to the next text's."""
    for batch in tk.slices(batches):
        columns: dict[str, list] = {c: [] for c in ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        texts = [t or "" for t in batch.column(1).to_pylist()]
        edited = []
        for text, head in zip(texts, batch.column(2).to_pylist(), strict=True):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + (head or "")[:cut])
        for key, text, new, after, a, b in zip(batch.column(0).to_pylist(), texts, edited, batch.column(3).to_pylist(), fingerprints([t.encode() for t in texts]), fingerprints([t.encode() for t in edited]), strict=True):
            for c, v in zip(columns, (key, len(text), hashlib.sha256(new.encode()).digest(), a, b, likeness(a, b), likeness(a, after)), strict=True):
                columns[c].append(v)
        kinds = {"key": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.binary())) for c, v in columns.items()], names=list(columns))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness to each other and to the next document's.

    Each text is shuffled once, by its id, and its head once more to the document before. Of rows with one id the
    smallest head stands for that id as a next document; rows without an id come first, as one id. class_id is the
    smallest id of the documents with the same fingerprint, component_id that of all linked within RADIUS.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = materialize(_next_ids(texts.select("key")))
    sizes = texts.select("key", F.length("text").alias("n")).groupBy("key").agg((F.max("n") / 4).cast("int").alias("need"))
    needs = order.join(sizes, "key").select(F.col("key").alias("before"), F.col("after").alias("key"), "need")
    heads = texts.join(needs, "key").select(F.col("before").alias("key"), "text", "need").mapInArrow(_heads, "key long, head string, next binary")
    heads = heads.groupBy("key").agg(F.min(F.struct("head", "next")).alias("x")).select("key", "x.head", "x.next")
    made = texts.join(heads, "key").select("key", "text", "head", "next").mapInArrow(_edited, "key long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")
    as_hex = [F.lower(F.hex(c)).alias(c) if c in ("edited_sha256", "fingerprint", "edited_fingerprint") else F.col(c) for c in made.columns[1:]]
    # The table is written first, so that the shuffle of all texts is gone before those of the block tables begin.
    made = materialize(made.select(F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), *as_hex))
    del texts, heads
    free_shuffles(spark)
    placed = near_classes(made).withColumnRenamed("print", "fingerprint")
    copies = made.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows(made.count()))
    hot = placed.join(materialize(copies.select("fingerprint")), "fingerprint").select(*placed.columns)
    out = join_by_key(made, placed, ["fingerprint"], materialize(hot))
    return out.select(*made.columns, "class_id", "component_id")
