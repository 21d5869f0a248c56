"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal sets are one row of the matrix. Which rows are multiplied at all is decided on few columns: if
two sets reach the similarity, the first ``n - ceil(t n) + 1`` members of both, in one order of all shingles, share a
member; so only these columns are opened, frequent shingles ordered last. In each open column a hub is paired with
the other rows; what a column still has in several components is paired in blocks, where a parity bitmap bounds the
overlap from above. No pair inside one component is needed, so the work on a group of near copies grows with its
size, not its square, and no link between different components is ever skipped.

The pairs left are entries of the product to be computed: one row times a block of rows, column block by column
block. Overlap counts are accumulated, and after each column block a pair goes whose count and the columns that
either row has left cannot reach the size-derived bound ``overlap >= t (n_a + n_b) / (1 + t)``.

Shingles are 64-bit hashes and equal sets are known by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.llm import skew
from commstream.llm import textkit as tk
from commstream.operators.components import connected_components
from commstream.storage import materialize

NULL_ID = (1 << 63) - 1
BITMAP_WORDS = 8
BLOCK_ROWS = 512
FREQUENT_SHARE = 1000
COUNT_ROWS = 2_000_000
BROADCAST_KEYS = 500_000
PRODUCT_ROWS = 512
PRODUCT_COLUMNS = 1024


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _signature(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(tk.mix(s + np.uint64(77)))) if len(s) else 0


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    data, offsets = tk.text_bytes(batch.column(1))
    starts, ends, first = tk.word_spans(data, offsets)
    words = tk.word_hashes(data, starts, ends, lower=True)
    for i in range(batch.num_rows):
        yield tk.shingle_sets(words[first[i] : first[i + 1]], k)


def _often(k: int, num: int, den: int):
    """Shingles that two or more documents of a task have among the first 2 x prefix, with their number."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        for batch in tk.slices(batches):
            for s in _sets(batch, k):
                held.append(s[: 2 * _prefix(len(s), num, den)])
                size += len(held[-1])
            if size > COUNT_ROWS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _rows(k: int, num: int, den: int, late):
    """key, set size, set signature, parity bitmap, prefix: one row for each document.

    The bit h mod 2^w of a wide bitmap is the parity of the members h there; about two members share a bit. Halves
    combined by XOR are the bitmap of half the width, and bits is the smallest.
    """

    def run(batches):
        last = late.value
        for batch in tk.slices(batches):
            n, s1, s2, bits, wide, prefix = [], [], [], [], [], []
            for s in _sets(batch, k):
                n.append(len(s))
                first, second = _signature(s)
                s1.append(first)
                s2.append(second)
                size = 64 * BITMAP_WORDS
                while 2 * size < len(s):
                    size *= 2
                odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
                wide.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                bits.append(np.bitwise_xor.reduce(wide[-1].reshape(-1, BITMAP_WORDS)))
                if len(last) and len(s):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    often = last[at] == s
                    if often.any():
                        s = np.concatenate([s[~often], s[often]])
                prefix.append(s[: _prefix(len(s), num, den)].view(np.int64))
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32)), pa.array(np.concatenate(x)))
            unsigned = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), unsigned(s1), unsigned(s2), listed(bits), listed(wide), listed(prefix)],
                names=["key", "n", "s1", "s2", "bits", "wide", "prefix"],
            )

    return run


def _whole_sets(k: int):
    """key, set signature and the whole set, sorted as unsigned numbers."""

    def run(batches):
        for batch in tk.slices(batches):
            sets = list(_sets(batch, k))
            signs = np.array([_signature(x) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs[:, 0]), pa.array(signs[:, 1]), items], names=["key", "s1", "s2", "items"])

    return run


def overlap_counts(row: np.ndarray, items: np.ndarray, first: np.ndarray, num: int, den: int, columns: int = PRODUCT_COLUMNS) -> np.ndarray:
    """One row of the matrix times a block of rows: overlap counts, -1 where the bound was missed on the way.

    row and each of the block's rows (items[first[i] : first[i + 1]]) are sorted. Columns are taken in blocks of the
    row's own, in order.
    """
    sizes = np.diff(first)
    need = minimum_overlap(len(row), sizes, num, den)
    count, alive, at = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), first[:-1].copy()
    for start in range(0, len(row), columns):
        block = row[start : start + columns]
        ends = first[alive + 1]
        if start + columns < len(row):  # where each row's members up to the block's last column end
            lo, hi = at[alive], ends.copy()
            while (open_rows := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_rows] + hi[open_rows]) >> 1
                below = items[mid] <= block[-1]
                lo[open_rows[below]], hi[open_rows[~below]] = mid[below] + 1, mid[~below]
            upto = lo
        else:
            upto = ends
        n = upto - at[alive]
        held = items[np.repeat(at[alive] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        hit = block[np.minimum(np.searchsorted(block, held), len(block) - 1)] == held
        count[alive] += np.bincount(np.repeat(np.arange(len(alive)), n)[hit], minlength=len(alive))
        at[alive] = upto
        most = count[alive] + np.minimum(len(row) - start - len(block), ends - upto)
        alive = alive[most >= need[alive]]
        if not len(alive):
            break
    out = np.full(len(sizes), -1, np.int64)
    out[alive] = count[alive]
    return out


def _product(num: int, den: int):
    """Links among the pairs of one row (part 0, which comes first in its group) and the others of its block."""

    def run(batches):
        head, row = None, np.zeros(0, np.uint64)
        for batch in batches:
            name, block, part, v = (batch.column(i).to_numpy() for i in range(4))
            first, items = batch.column(4).offsets.to_numpy().astype(np.int64), batch.column(4).values.to_numpy().view(np.uint64)
            cuts = np.flatnonzero((name[1:] != name[:-1]) | (block[1:] != block[:-1])) + 1
            a, b = [], []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(name)], strict=True):
                if part[lo] == 0:
                    head, row, lo = (name[lo], block[lo]), items[first[lo] : first[lo + 1]].copy(), lo + 1
                if lo == hi:
                    continue
                assert head == (name[lo], block[lo])
                counts = overlap_counts(row, items, first[lo : hi + 1], num, den)
                # A count that was not cut short is exact.
                links = np.flatnonzero(counts * (den + num) >= (len(row) + np.diff(first[lo : hi + 1])) * num)
                a.append(np.full(len(links), name[lo]))
                b.append(v[lo:hi][links])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    return run


def _block_pairs(num: int, den: int):
    """Pairs of rows of one block pair that differ in component and that sizes and bitmaps allow to link.

    Input rows come sorted by g, a group of one column's one or two blocks. Rows of the group that a batch cuts
    are carried over, so at most one group and one batch are held.
    """

    def pairs(t: pa.Table):
        g, key, n, comp, blk, cross = (t.column(c).to_numpy() for c in ("g", "key", "n", "comp", "blk", "cross"))
        bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP_WORDS)
        d, rows = 1, np.arange(len(g))
        while len(rows := rows[rows + d < len(g)]) and len(rows := rows[g[rows] == g[rows + d]]):
            for part in np.array_split(rows, max(1, len(rows) // 200_000)):
                a, b = part, part + d
                ok = (comp[a] != comp[b]) & (~cross[a] | (blk[a] != blk[b])) & (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num)
                a, b = a[ok], b[ok]
                if len(a):
                    apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
                    ok = apart * (den + num) <= (n[a] + n[b]) * (den - num)
                    a, b = key[a[ok]], key[b[ok]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            d += 1

    def run(batches):
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t])
            g = t.column("g").to_numpy()
            if not len(g):
                continue
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            kept = t.slice(cut).combine_chunks()
            if cut:
                yield from pairs(t.slice(0, cut))
        if kept is not None:
            yield from pairs(kept)

    return run


def minimum_overlap(n_a, n_b, num: int, den: int):
    """The smallest overlap of two sets of these sizes whose similarity is num / den or more."""
    return -(-num * (n_a + n_b) // (num + den))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", hub_rounds: int = 2) -> DataFrame:
    """(id_col, n_shingles, component_id, class_id), a row for each row of docs; the similarity is num / den.

    Null and empty texts have no shingle and stand alone, as their own component. Rows that share an id are linked
    with each other, whatever their texts; each links with others by its own text. Null ids are kept: their component
    is the smallest other id they reach, else null. Equal sets are one class (class_id: its smallest id). Very long
    texts are taken whole, in column blocks. Pairs at the similarity exactly (ties) link. Extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.col(text_col).cast("string").alias("text"))
    often = texts.mapInArrow(tk.released(_often(k, num, den)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = texts.count()
    # At most FREQUENT_SHARE x 2 x the mean prefix length can be this frequent, whatever the number of documents.
    late = often.where(F.col("n") >= max(64, total // FREQUENT_SHARE)).select("h").toPandas()["h"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(np.sort(late.view(np.uint64)))
    rows = materialize(texts.mapInArrow(tk.released(_rows(k, num, den, held)), "key long, n long, s1 long, s2 long, bits array<long>, wide array<long>, prefix array<long>"))
    # A class of equal sets is a node v; a group of copies of any size is counted before it is shuffled.
    sign = ["s1", "s2", "n"]
    sets = materialize(rows.where("n > 0").groupBy(*sign).agg(F.min("key").alias("rep"), F.count("*").alias("copies")).withColumn("v", F.monotonically_increasing_id()))
    many = materialize(sets.where(F.col("copies") >= skew.hot_rows(total)))
    placing = sets.select(*sign, "v", "rep")
    member = materialize(skew.join_by_key(rows.where("n > 0").select("key", *sign), placing, sign, many).select("key", "n", "v", "rep"))
    firsts = placing.withColumnRenamed("rep", "key")
    reps = materialize(rows.where("n > 0").join(firsts, ["key", *sign]).dropDuplicates(["v"]))

    incidence = reps.select("v", "n", F.explode("prefix").alias("h"))
    column = materialize(incidence.groupBy("h").agg(F.min("v").alias("hub"), F.max("v").alias("top"), F.count("*").alias("rows")).where("hub <> top"))
    # Columns of very common shingles are few, and joined without a shuffle of their cells.
    wide_from = skew.hot_rows(int(column.agg(F.sum("rows")).first()[0] or 0))
    cells = materialize(skew.join_by_key(incidence, column.select("h", "hub"), ["h"], column.where(F.col("rows") >= wide_from)).select("h", "v", "n", "hub"))

    known = reps.select("v", "n", "wide")

    def halved(x):
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    def overlaps(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that link. Sizes and bitmaps bound the overlap first; what is left is multiplied."""
        left, right = known.toDF("a", "n", "x"), known.toDF("b", "m", "y")
        x, y = (F.when(F.size(x) > F.size(y), halved(x)).otherwise(F.col(x)) for x, y in (("x", "y"), ("y", "x")))
        apart = F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        may = pairs.join(left, "a").join(right, "b").where(f"least(n, m) * {den} >= greatest(n, m) * {num}").where(apart * (den + num) <= (F.col("n") + F.col("m")) * (den - num))
        may = materialize(may.select("a", "b").distinct())
        wanted = materialize(may.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(reps.select("v", "key", "s1", "s2"), "v"))
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
        items = materialize(texts.join(wanted.select("key").distinct(), "key", "left_semi").mapInArrow(tk.released(_whole_sets(k)), "key long, s1 long, s2 long, items array<long>").join(wanted, ["key", "s1", "s2"]).select("v", "items").dropDuplicates(["v"]))
        # A row of the matrix with more partners than fit a block stands at the head of several.
        blocks = may.groupBy("a").agg(F.ceil(F.count("*") / PRODUCT_ROWS).cast("int").alias("blocks"))
        dealt = materialize(may.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")))
        heads = dealt.select("a", "block", F.lit(0).alias("part"), F.col("a").alias("v")).distinct()
        entries = heads.unionByName(dealt.select("a", "block", F.lit(1).alias("part"), F.col("b").alias("v"))).join(items, "v").select("a", "block", "part", "v", "items")
        return entries.repartition("a", "block").sortWithinPartitions("a", "block", "part").mapInArrow(tk.released(_product(num, den)), "a long, b long")

    # Most pairs come from many of their shared columns.
    done = materialize(cells.where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct())
    # Rows that share an id are linked whatever their texts.
    same = member.where(F.col("key") != NULL_ID).groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("top")).where("a <> top").select("key", "a")
    links = materialize(overlaps(done).unionByName(member.join(same, "key").where("v <> a").select("a", F.col("v").alias("b"))))
    comps = materialize(connected_components(links))

    def open_cells() -> DataFrame:
        """Cells of columns that still hold several components."""
        now = cells.join(comps, "v", "left").select("h", "v", "n", F.coalesce("component", "v").alias("comp"))
        several = now.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("h", "rows")
        several = materialize(several)
        return materialize(skew.join_by_key(now, several, ["h"], several.where(F.col("rows") >= wide_from)))

    left = open_cells()
    for r in range(1, hub_rounds):
        if left.isEmpty():
            break
        hub = left.groupBy("h").agg(F.max("rows").alias("rows"), F.min_by(F.struct("v", "comp", F.col("n").alias("m")), F.xxhash64(F.lit(r), "h", "v")).alias("hub"))
        hub = materialize(hub.select("h", "rows", "hub.v", "hub.comp", "hub.m").toDF("h", "rows", "hub", "hub_comp", "m"))
        tried = skew.join_by_key(left.drop("rows"), hub.drop("rows"), ["h"], hub.where(F.col("rows") >= wide_from)).where("comp <> hub_comp").where(f"least(n, m) * {den} >= greatest(n, m) * {num}")
        pairs = tried.select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"))
        done = done.unionByName(pairs)
        links = links.unionByName(materialize(overlaps(pairs)))
        comps = connected_components(links)
        left = open_cells()

    count = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    dealt = left.withColumn("blocks", count).withColumn("blk", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(reps.select("v", "bits"), "v")
    # The group of blocks i < j holds both blocks; the group of block i alone holds it once.
    group = F.xxhash64("h", F.least("blk", "to"), F.greatest("blk", "to")).alias("g")
    shaped = dealt.select(group, F.col("v").alias("key"), "n", "comp", F.col("blk").cast("long").alias("blk"), (F.col("blk") != F.col("to")).alias("cross"), "bits")
    if not left.isEmpty():
        rest = shaped.repartition("g").sortWithinPartitions("g", "n").mapInArrow(tk.released(_block_pairs(num, den)), "a long, b long").distinct()
        links = links.unionByName(materialize(overlaps(materialize(rest.join(done, ["a", "b"], "left_anti")))))
        comps = connected_components(links)
    named = placing.select("v", "rep").join(comps, "v", "left").select("v", F.coalesce("component", "v").alias("component"), "rep")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(least, "component").select("v", "component_id"))
    hot = named.join(F.broadcast(many.select("v")), "v", "left_semi")
    linked = skew.join_by_key(member, named, ["v"], hot).select("key", "n", "rep", "component_id")
    alone = rows.where("n = 0").select("key", "n", F.col("key").alias("rep"), F.col("key").alias("component_id"))
    whole = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return linked.unionByName(alone).select(whole("key").alias(id_col), F.col("n").alias("n_shingles"), whole("component_id").alias("component_id"), whole("rep").alias("class_id"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Links at 3-word shingles and similarity 0.9 over all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=9, den=10)
