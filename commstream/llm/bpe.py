"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaves hold ``rank * width + position`` of each adjacent pair, inner nodes the smaller child, so the root is the
leftmost pair of lowest rank. A merge updates the leaves of the pair, of its left neighbour and of the right one,
each in logarithmic time, until the root says that no pair can be merged. Words of one padded length are merged side
by side as rows of one array of trees; longer words have a tree of their own.

Text is normalised and cut as the vocabulary's file says: NFC, white space runs to one space, lower case by code
point; special tokens are cut out of the raw text first. What counts as a letter, a number or white space, and lower
case, differ between versions of Unicode: texts with characters beyond PLAIN are normalised and cut by the tokenizers
library's own components, so that its version holds. White space ends every word, so chunks between white space are
encoded once for each worker and kept in a bounded table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.llm import textkit as tk

CACHE_CHUNKS = 60_000
RECURRING_CHUNKS = 33_000
BATCH_WIDTHS = (4, 8, 16, 32)
NONE = np.int64(1 << 62)
#: A character that is treated by the library; all others are alike in every version of Unicode (a test walks them all).
BEYOND_PLAIN = regex.compile("[^\x00-\u024f\u2010-\u2027]")


def library_normalizer(spec: dict) -> tokenizers.normalizers.Normalizer:
    """The normaliser that a vocabulary's file describes."""
    kinds = {"NFC": lambda x: tokenizers.normalizers.NFC(), "Lowercase": lambda x: tokenizers.normalizers.Lowercase(), "Replace": lambda x: tokenizers.normalizers.Replace(tokenizers.Regex(x["pattern"]["Regex"]), x["content"])}
    return tokenizers.normalizers.Sequence([kinds[x["type"]](x) for x in spec["normalizers"]])


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Bpe:
    """A vocabulary with merges, from a JSON file of the tokenizers library (BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(pattern + "|\n")
        self.normalizer = library_normalizer(spec["normalizer"])
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        letters = byte_letters()
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[letters[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max(self.vocab.values()) + 1
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.made_by_rank = made
        bits = 1 << 20  # a filter before the search: most adjacent pairs have no merge
        self.filter = np.zeros(bits, bool)
        self.filter[self._slot(keys)] = True
        self.letters = {v: k for k, v in letters.items()}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        top = max(self.text_of) + 1
        #: By id: its decimal number and its text, and how long each is with the space after it.
        self.number_of = np.array([str(i) for i in range(top)], object)
        self.written_of = np.array([self.text_of.get(i, "") for i in range(top)], object)
        self.number_size, self.written_size = (np.array([len(x) + 1 for x in y], np.int64) for y in (self.number_of, self.written_of))
        self.ids_of: dict[str, str] = {}
        self.decoded_of: dict[str, str] = {}
        self.recurring: set[str] = set()
        self.blank = False

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1: no merge."""
        keys = left * self.size + right
        rank = np.full(len(keys), -1, np.int64)
        may = np.flatnonzero(self.filter[self._slot(keys)] & (left >= 0) & (right >= 0))
        at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
        hit = self.keys[at] == keys[may]
        rank[may[hit]] = self.ranks[at[hit]]
        return rank

    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words side by side: ids has a row for each word, padded with -1 to a power of two.

        The tokens of one word after another, and how many each has.
        """
        n, width = ids.shape
        # One more leaf after each row's last position stands for "no neighbour"; all arrays are addressed flat.
        ids = np.hstack([ids, np.full((n, 1), -1, np.int64)]).ravel()
        tree = np.full((n, 2 * width), NONE, np.int64)
        nxt = np.tile(np.arange(1, width + 2), n)
        prv = np.tile(np.concatenate([[width], np.arange(width)]), n)
        grid = ids.reshape(n, width + 1)
        rows, cols = np.nonzero(np.arange(width) < (lengths - 1)[:, None])
        rank = self._find(grid[rows, cols], grid[rows, cols + 1])
        tree[rows, width + cols] = np.where(rank >= 0, rank * width + cols, NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        tree = tree.ravel()
        base, root = np.arange(n) * (width + 1), np.arange(n) * (2 * width)
        top = tree[root + 1]
        live = np.flatnonzero(top < NONE)
        base, root, top = base[live], root[live], top[live]
        while len(top):
            rank, at = np.divmod(top, width)
            here = base + at
            right = nxt[here]
            ids[here] = self.made_by_rank[rank]
            ids[base + right] = -1
            after = nxt[base + right]
            nxt[here] = after
            prv[base + np.minimum(after, width)] = at
            left = prv[here]
            new, ends = ids[here], np.minimum(after, width)
            rank = self._find(np.concatenate([new, ids[base + left]]), np.concatenate([ids[base + ends], new]))
            leaf = np.concatenate([at, np.minimum(left, width - 1)])
            value = np.where(rank >= 0, rank * width + leaf, NONE)
            # Without a left neighbour the third update repeats the second one's leaf.
            alone = np.flatnonzero(left == width)
            leaf[len(at) + alone], value[len(at) + alone] = at[alone], value[alone]
            node = np.concatenate([right, leaf]) + width
            trees = np.concatenate([root, root, root])
            tree[trees + node] = np.concatenate([np.full(len(right), NONE), value])
            level = width
            while level > 1:
                node, level = node >> 1, level >> 1
                child = trees + node + node
                tree[trees + node] = np.minimum(tree[child], tree[child + 1])
            top = tree[root + 1]
            live = np.flatnonzero(top < NONE)
            if len(live) < len(top):
                base, root, top = base[live], root[live], top[live]
        ids = ids.reshape(n, width + 1)
        return ids[ids >= 0], (ids >= 0).sum(1)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Merge one word of any length with its own tree."""
        n, width = len(ids), 1
        while width < len(ids):
            width *= 2
        none, size, rank_of = 1 << 62, self.size, self.rank_of
        tree = [none] * (2 * width)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            rank = rank_of.get(ids[i] * size + ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(i, value):
            i += width
            tree[i] = value
            i //= 2
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low
                i //= 2

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            right = nxt[at]
            ids[at], ids[right] = int(self.made_by_rank[rank]), -1
            after = nxt[at] = nxt[right]
            update(right, none)
            if after < n:
                prv[after] = at
            rank = rank_of.get(ids[at] * size + ids[after]) if after < n else None
            update(at, none if rank is None else rank * width + at)
            if (left := prv[at]) >= 0:
                rank = rank_of.get(ids[left] * size + ids[at])
                update(left, none if rank is None else rank * width + left)
        return [x for x in ids if x >= 0]

    def _encode_spans(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words at starts of data (bytes, at least one each), one after another, and how many each has."""
        parts, n_tokens, low = [], np.zeros(len(starts), np.int64), 0
        for width in BATCH_WIDTHS:
            mine = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for part in np.array_split(mine, len(mine) // 4096 + 1):
                if not len(part):
                    continue
                size = lengths[part]
                row = np.repeat(np.arange(len(part)), size)
                col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                ids = np.full((len(part), width), -1, np.int64)
                ids[row, col] = self.inner[data[starts[part][row] + col]]
                ids[np.arange(len(part)), size - 1] = self.last[data[starts[part] + size - 1]]
                tokens, n_tokens[part] = self._merge_rows(ids, size)
                parts.append((part, tokens))
        for i in np.flatnonzero(lengths > low).tolist():
            own = data[starts[i] : starts[i] + lengths[i]]
            ids = self.inner[own].tolist()
            ids[-1] = int(self.last[own[-1]])
            tokens = np.array(self._merge_long(ids), np.int64)
            n_tokens[i] = len(tokens)
            parts.append((np.array([i]), tokens))
        first, out = np.cumsum(n_tokens) - n_tokens, np.empty(int(n_tokens.sum()), np.int64)
        for part, tokens in parts:
            n = n_tokens[part]
            out[np.arange(len(tokens)) + np.repeat(first[part] - (np.cumsum(n) - n), n)] = tokens
        return out, n_tokens

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, given as its bytes (at least one)."""
        lengths = np.array([len(w) for w in words], np.int64)
        ids, n = self._encode_spans(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)
        flat, cuts = ids.tolist(), np.cumsum(n).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _chunks(self, text: str) -> list[str]:
        """Normalised runs without white space; the separators 0x1C-0x1F are not white space here."""
        if text.isascii():
            text = text.lower()
            return text.split() if not regex.search("[\x1c-\x1f]", text) else [x for x in regex.split("[\t-\r ]+", text) if x]
        if BEYOND_PLAIN.search(text):
            return [x for x in self.normalizer.normalize_str(text).split(" ") if x]
        text = unicodedata.normalize("NFC", text).lower()
        return [x for x in regex.split("[\t-\r \x85\xa0]+", text) if x] if regex.search("[\x1c-\x1f]", text) else text.split()

    def _pieces(self, chunks: list[str]) -> tuple[list[str], list[str]]:
        """The chunks, those of plain characters first, and the words of each followed by a line end."""
        plain, beyond = chunks, []
        if BEYOND_PLAIN.search("".join(chunks)):
            beyond = [c for c in chunks if not c.isascii() and BEYOND_PLAIN.search(c)]
            kept = set(beyond)
            plain = [c for c in chunks if c not in kept]
        found = self.pieces.findall("\n".join([*plain, ""]))
        for c in beyond:
            found += [x for x, _ in self.splitter.pre_tokenize_str(c)]
            found.append("\n")
        return plain + beyond, found

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with special tokens kept, where the file names no decoder: tokens joined by spaces."""
        return " ".join(self.text_of[i] for i in ids)

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that the table lacks. A full table keeps the chunks that came back, then starts anew."""
        ids_of, decoded_of = self.ids_of, self.decoded_of
        new = chunks.difference(ids_of)
        self.recurring |= chunks - new
        if len(ids_of) + len(new) > CACHE_CHUNKS:
            if len(self.recurring) > RECURRING_CHUNKS:
                self.recurring = chunks - new
            keep = self.recurring | (chunks - new)
            ids_of = self.ids_of = {c: ids_of[c] for c in keep if c in ids_of}
            decoded_of = self.decoded_of = {c: decoded_of[c] for c in ids_of}
        if not new:
            return
        order, found = self._pieces(list(new))
        data = np.frombuffer("\t".join(found).encode(), np.uint8)
        ends = np.append(np.flatnonzero(data == 9), len(data))
        starts = np.concatenate([[0], ends[:-1] + 1])
        line = data[starts] == 10
        ids, n = self._encode_spans(data, starts[~line], (ends - starts)[~line])
        # Tokens before each word, words before the end of each chunk.
        before, words = np.concatenate([[0], np.cumsum(n)]), np.flatnonzero(line) - np.arange(len(order))
        cut = np.concatenate([[0], before[words]])
        self.blank |= bool((cut[1:] == cut[:-1]).any())
        for table, texts, sizes in ((ids_of, self.number_of, self.number_size), (decoded_of, self.written_of, self.written_size)):
            whole, at = " ".join(texts[ids].tolist()), np.concatenate([[0], np.cumsum(sizes[ids])])[cut]
            low, high = at[:-1].tolist(), np.maximum(at[1:] - 1, at[:-1]).tolist()
            table.update(zip(order, [whole[a:b] for a, b in zip(low, high, strict=True)], strict=True))

    def forget(self) -> None:
        """Empty the table of chunks; Spark keeps a worker process, and what it holds, for later stages."""
        self.ids_of, self.decoded_of, self.recurring = {}, {}, set()

    def encode_texts(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """For each text its ids as decimal numbers joined by a space, their number, and the decoded text."""
        out, todo, held = [], [], set()

        def finish():
            self.learn(held)
            out.extend(self._joined(x) for x in todo)
            todo.clear()
            held.clear()

        for text in texts:
            text = text or ""
            own = [self._chunks(text)] if "<|" not in text else []
            if not own:
                at = 0
                for m in self.cut_special.finditer(text):
                    own += [self._chunks(text[at : m.start()]), m.group()]
                    at = m.end()
                own.append(self._chunks(text[at:]))
            todo.append(own)
            for part in own[::2]:
                held.update(part)
            if len(held) > CACHE_CHUNKS // 3:
                finish()
        finish()
        return out

    def _joined(self, own: list) -> tuple[str, int, str]:
        """own: lists of chunks with special tokens between them."""
        ids, decoded = [], []
        for i, part in enumerate(own):
            if i % 2:
                ids.append(str(self.special[part]))
                decoded.append(part)
            elif part:
                ids.append(" ".join(map(self.ids_of.__getitem__, part)))
                decoded.append(" ".join(map(self.decoded_of.__getitem__, part)))
                if self.blank:
                    filled = [c for c in part if self.ids_of[c]]
                    ids[-1], decoded[-1] = (" ".join([t[c] for c in filled]) for t in (self.ids_of, self.decoded_of))
        text = " ".join([x for x in ids if x])
        return text, text.count(" ") + 1 if text else 0, " ".join([x for i, x in enumerate(decoded) if ids[i]])


@functools.lru_cache(2)
def load(path: str) -> Bpe:
    found = Bpe(path)
    tk.release_memory()  # what the file took to parse
    return found


def _encode(path: str, digests: bool):
    def run(batches):
        bpe = load(path)
        try:
            for batch in tk.slices(batches, limit=512 << 10):
                done = bpe.encode_texts(batch.column(1).to_pylist())
                ids, n, text = ([x[i] for x in done] for i in range(3))
                if digests:
                    ids, text = ([hashlib.sha256(x.encode()).hexdigest() for x in y] for y in (ids, text))
                    columns = [pa.array(ids, pa.string())]
                else:
                    split = pc.split_pattern(pa.array(ids, pa.string()), " ")
                    cuts = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    values = split.flatten()
                    columns = [pa.ListArray.from_arrays(cuts, values.filter(pc.not_equal(values, "")).cast(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *columns, pa.array(text, pa.string())], names=["id", "n_tokens", "ids", "decoded"])
        finally:
            bpe.forget()
            tk.release_memory()

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids, decoded), a row for each row of docs, in one pass without a shuffle.

    path: the vocabulary file, present on every executor. ids is an array of int; with digests=True ids and decoded
    are SHA-256 digests of the decimal ids joined by a space and of the decoded text. Null texts count as empty: no
    token, empty text. Null and repeated ids pass through; extra columns are ignored; an empty table gives an empty
    result. Texts are encoded whole, each long word by a tree of its own; of pairs of one rank (ties) the leftmost
    merges first.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "string" if digests else "array<int>"
    return texts.mapInArrow(_encode(path, digests), f"id long, n_tokens long, ids {kind}, decoded string").withColumnRenamed("id", id_col)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the 49k word BPE."""
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
