"""Substring dedup by relative Lempel-Ziv parsing of every document against all earlier text.

The reference is the corpus itself, in order of id, cut into blocks of one document. Its index has two levels:
anchors (the smallest 8-word hash in each 20-word window, about one word in seven) find which windows can repeat at
all. Consecutive windows with one anchor are a chunk, of 32 words at most: an index of chunks gives each its first
place, and an index of the windows in first copies of chunks gives those theirs. (The first copy of a window lies in
the first copy of a chunk, since any other copy of that chunk would hold an earlier one.) A document is then factored greedily from left to
right: at a window with an earlier copy, the factor runs on for as long as the copy runs on at the same place of the
reference. Factors of window length or more are duplicate spans; windows that begin in a factor's last words and
have their copy elsewhere are looked up again, so no repeat across a factor's boundary is missed. The spans together
are exactly the words that windows with an earlier copy cover.

Anchors only choose what is looked up. Windows and chunks are known by two hashes of 64 bits each, of the words' 64-bit
hashes, and a document takes a row of the index only if its own words give both.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.llm import textkit as tk
from commstream.llm.skew import hot_rows, join_by_key
from commstream.storage import drop_tables, materialize

NULL_ID = -(1 << 63)
GRAM = 8
SECOND = np.uint64(0xD1B54A32D192ED03)


def _windows(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By first word: each window's hash of all its words, its anchor (smallest gram hash in it), every gram's hash."""
    if len(words) < window:
        return (np.zeros(0, np.uint64),) * 3
    grams, wide, span = tk.run_hashes(words, GRAM), window - GRAM + 1, 1
    low = grams
    while span * 2 <= wide:
        low, span = np.minimum(low[: len(low) - span], low[span:]), span * 2
    n = len(grams) - wide + 1
    return tk.run_hashes(words, window), np.minimum(low[:n], low[wide - span : wide - span + n]), grams


def _second(words: np.ndarray, window: int) -> np.ndarray:
    """By first word: another hash of each window, from other values of its words."""
    return tk.run_hashes(tk.mix(words ^ SECOND), window)


def _bounds(first: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Each text's first window and the end of its windows, among those of all words of a slice."""
    return list(zip(first[:-1].tolist(), np.maximum(first[:-1], first[1:] - window + 1).tolist(), strict=True))


def _starts(low: np.ndarray, grams: np.ndarray, window: int) -> np.ndarray:
    """Whether a window's anchor stands at another place than that of the window before."""
    wide = window - GRAM + 1
    at = np.zeros(len(low), np.int8)
    for o in range(wide - 1, -1, -1):
        np.copyto(at, np.int8(o), where=grams[o : o + len(low)] == low)
    at = at + np.arange(len(low))
    return np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)


def _span(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of n consecutive windows whose first and last overlap or meet, so that these two give all words."""
    return np.where(n == 1, first, tk.mix(first * np.uint64(2) + last + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _anchors(window: int):
    """key and its anchors, each as often as it stands at another place of the document."""

    def run(batches):
        for batch in tk.slices(batches):
            data, offsets = tk.text_bytes(batch.column(1))
            starts, ends, first = tk.word_spans(data, offsets)
            words = tk.word_hashes(data, starts, ends)
            _, low, grams = _windows(words, window)
            new = _starts(low, grams, window)
            low, out = low.view(np.int64), []
            for a, b in _bounds(first, window):
                if b > a:
                    new[a] = True
                out.append(low[a:b][new[a:b]])
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(out)))], names=["key", "anchors"])

    return run


def _may_repeat(window: int):
    """chunk and check (its hashes), key, pos and both hashes of its windows, for chunks whose anchor stands in the document's list."""

    def run(batches):
        for batch in tk.slices(batches):
            data, offsets = tk.text_bytes(batch.column(1))
            starts, ends, first = tk.word_spans(data, offsets)
            words = tk.word_hashes(data, starts, ends)
            whole, low, grams = _windows(words, window)
            other = _second(words, window)
            new, keys, own = _starts(low, grams, window), batch.column(0).to_numpy(), batch.column(2)
            listed, cuts = np.asarray(own.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            heads, tails, key, pos = [], [], [], []
            for i, (a, b) in enumerate(_bounds(first, window)):
                if a == b:
                    continue
                new[a] = True
                mine, head = np.sort(listed[cuts[i] : cuts[i + 1]]), a + np.flatnonzero(new[a:b])
                tail, near = np.append(head[1:], b), np.minimum(np.searchsorted(mine, low[head]), len(mine) - 1)
                again = mine[near] == low[head]
                heads.append(head[again])
                tails.append(tail[again])
                pos.append(head[again] - a)
                key.append(np.full(int(again.sum()), keys[i], np.int64))
            if not heads:
                continue
            head, tail = np.concatenate(heads), np.concatenate(tails)
            n = tail - head
            ends_at = np.concatenate([[0], np.cumsum(n)])
            held = np.repeat(head - ends_at[:-1], n) + np.arange(ends_at[-1])
            lists = [pa.ListArray.from_arrays(pa.array(ends_at.astype(np.int32)), pa.array(x.view(np.int64)[held])) for x in (whole, other)]
            names = [pa.array(_span(x[head], x[tail - 1], n).view(np.int64)) for x in (whole, other)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(np.concatenate(key)), pa.array(np.concatenate(pos).astype(np.int32)), *lists], names=["chunk", "check", "key", "pos", "hashes", "checks"])

    return run


def parse(pos: np.ndarray, ref: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors of one document as (first word, number of words).

    pos: starts of the windows with an earlier copy, ascending; ref, at: document and word where that copy starts.
    Factors found at the boundary of another one are listed too, so spans may overlap.
    """
    if not len(pos):
        return []
    run_on = (pos[1:] == pos[:-1] + 1) & (ref[1:] == ref[:-1]) & (at[1:] == at[:-1] + 1)
    heads = np.flatnonzero(np.concatenate([[True], ~run_on]))
    tails = np.concatenate([heads[1:], [len(pos)]]) - 1
    return [(int(pos[a]), int(pos[b] - pos[a]) + window) for a, b in zip(heads, tails, strict=True)]


def _remove(window: int, keep_text: bool):
    def run(batches):
        for batch in tk.slices(batches):
            data, offsets = tk.text_bytes(batch.column(1))
            starts, ends, first = tk.word_spans(data, offsets)
            raw = data.tobytes()
            words = tk.word_hashes(data, starts, ends)
            every, second = tk.run_hashes(words, window), _second(words, window)
            found, out = batch.column(2), {"key": batch.column(0), "n_words": [], "n_removed": [], "n_factors": [], "spans": [], "kept": []}
            for i in range(batch.num_rows):
                lo, hi = int(first[i]), int(first[i + 1])
                gone, factors = np.zeros(hi - lo + 1, np.int64), []
                if found[i].is_valid and len(found[i]):
                    rows = found[i].values
                    h, check, pos, n, ref, at = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("h", "check", "pos", "n", "ref", "at"))
                    order = np.argsort(pos, kind="stable")
                    order = order[pos[order] + n[order] <= hi - window + 1 - lo]
                    for own, given in ((every, h), (second, check)):
                        whole = own[lo : max(lo, hi - window + 1)]
                        order = order[_span(whole[pos[order]], whole[pos[order] + n[order] - 1], n[order]).view(np.int64) == given[order]]
                    step = np.arange(n[order].sum()) - np.repeat(np.cumsum(n[order]) - n[order], n[order])
                    pos, ref, at = np.repeat(pos[order], n[order]) + step, np.repeat(ref[order], n[order]), np.repeat(at[order], n[order]) + step
                    resort = np.argsort(pos, kind="stable")
                    pos, ref, at = pos[resort], ref[resort], at[resort]
                    once = np.concatenate([[True], pos[1:] != pos[:-1]]) if len(pos) else np.zeros(0, bool)
                    factors = parse(pos[once], ref[once], at[once], window)
                    for start, length in factors:
                        gone[start] += 1
                        gone[start + length] -= 1
                text = raw[offsets[i] : offsets[i + 1]].split()
                kept = text
                if factors:
                    kept = [text[j] for j in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                text = b" ".join(kept)
                out["n_words"].append(hi - lo)
                out["n_removed"].append(hi - lo - len(kept))
                out["n_factors"].append(len(factors))
                out["spans"].append(",".join(f"{a}:{a + n}" for a, n in factors))
                out["kept"].append(text.decode() if keep_text else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([out["key"], *(pa.array(out[c], pa.int64()) for c in ("n_words", "n_removed", "n_factors")), pa.array(out["spans"], pa.string()), pa.array(out["kept"], pa.string())], names=list(out))

    return run


def _hot(counted: DataFrame) -> DataFrame:
    """The rows of a table of keys whose count n is a large share of all counts, without n."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where(F.col("n") >= hot_rows(total)).drop("n")


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, n_factors, spans, kept), a row for each row of docs.

    Words covered by a window of so many words (at least 8) whose words also start earlier, in a smaller id or
    before it in the same text, go; kept is the rest joined by one space, or with keep_text=False its SHA-256.
    spans lists the factors as start:end in words. Null texts count as empty and have no word; null ids come
    first and count as one document; rows that repeat an id are one document, whose copies are not earlier than
    each other. Extra columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.col(text_col).cast("string").alias("text"))
    by = ["chunk", "check"]
    listed = materialize(texts.mapInArrow(_anchors(window), "key long, anchors array<long>"))
    anchors = listed.select("key", F.explode("anchors").alias("anchor"))
    again = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    own = join_by_key(anchors, again.select("anchor"), ["anchor"], _hot(again)).groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    chunks = materialize(texts.join(own, "key").mapInArrow(_may_repeat(window), "chunk long, check long, key long, pos int, hashes array<long>, checks array<long>"))
    drop_tables(listed, again)
    place = materialize(chunks.groupBy(*by).agg(F.min(F.struct("key", "pos")).alias("ref"), F.count("*").alias("n")).where("n > 1"))
    placed = join_by_key(chunks, place.drop("n"), by, _hot(place), "left")
    copied = F.coalesce(F.struct("key", "pos") > F.col("ref"), F.lit(False))
    # A later copy of a chunk needs its place alone; the first one its windows.
    held = F.when(~copied, F.arrays_zip("hashes", "checks")).alias("windows")
    placed = materialize(placed.select(*by, "key", "pos", F.size("hashes").alias("n"), F.when(copied, F.col("ref")).alias("ref"), held))
    drop_tables(chunks, place)
    rows = placed.where("ref is null").select("key", "pos", F.posexplode("windows").alias("o", "w"))
    rows = rows.select(F.col("w.hashes").alias("h"), F.col("w.checks").alias("check"), "key", (F.col("pos") + F.col("o")).alias("pos"))
    place = materialize(rows.groupBy("h", "check").agg(F.min(F.struct("key", "pos")).alias("ref"), F.count("*").alias("n")).where("n > 1"))
    windows = join_by_key(rows, place.drop("n"), ["h", "check"], _hot(place)).where(F.struct("key", "pos") > F.col("ref")).withColumn("n", F.lit(1))
    names = ["h", "check", "key", "pos", "ref", "n"]
    later = placed.where("ref is not null").withColumnRenamed("chunk", "h").select(*names).unionByName(windows.select(*names))
    later = later.select("key", F.struct("h", "check", "pos", "n", F.col("ref.key").alias("ref"), F.col("ref.pos").alias("at")).alias("row"))
    found = later.groupBy("key").agg(F.collect_list("row").alias("rows"))
    done = texts.join(found, "key", "left").mapInArrow(_remove(window, keep_text), "key long, n_words long, n_removed long, n_factors long, spans string, kept string")
    return done.select(F.when(F.col("key") != NULL_ID, F.col("key")).alias(id_col), "n_words", "n_removed", "n_factors", "spans", "kept")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows removed from all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return out.withColumnRenamed("kept", "kept_sha256")
