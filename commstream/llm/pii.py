"""Personal data: base patterns, and a skip-chain conditional random field that adds further mentions.

The nodes of a document's field are candidate segments: what the base patterns match, other number runs of 7 to 19
digits, other tokens with an at sign (written out too), and user names that an address of the document begins with.
Neighbours up to CHAIN_CHARS apart share a chain potential, and mentions of the same thing anywhere in the document
(the same last eight digits, the same user name) share a skip potential, each mention with a base match or, where
there is none, with the mention before. Loopy sum-product messages over both kinds of edges, sent until they change
no more, give marginals; a candidate that is no base match becomes a span where the marginal of a kind reaches
THRESHOLD. So a number written once with its country code marks its later mention without it, while the same number
alone stays unmarked; a written-out address is found without any base match. The field decides in every document
that has a candidate; everything before inference takes time linear in the text.

Weights of features, chain and skip edges are trained together by pseudo-likelihood on documents written by a seeded
generator (TRAIN_DOCUMENTS of them); nothing of the corpus is learned, so a run needs no pass to train.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commstream.llm import textkit as tk

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
CHAIN_CHARS = 40
ROUNDS = 200
SETTLED = 1e-4
THRESHOLD = 0.8
TRAIN_DOCUMENTS = 1500

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])+")
_AT = re.compile(r"@|\(at\)|\[at\]")
_HOST = re.compile(r" ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)*+")
_NAME = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*")
_CUE = re.compile(r"(?i)(tel|phone|call|mobile|mail|contact|card|visa|ip|host|addr|user)\W{0,3}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text: each at sign is tried once."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def written_addresses(text: str) -> list[tuple[int, int]]:
    """Segments around an at sign, written out or not, each sign tried once: leftmost, not overlapping."""
    found, last = [], 0
    for m in _AT.finditer(text):
        end = m.start() - (m.start() > last and text[m.start() - 1] == " ")
        start = end
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, m.end()) if start < end else None
        if host:
            last = host.end()
            found.append((start, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    found = [(a, b, 0) for a, b in _emails(text)]
    found += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for pattern, kind, low, high in ((_CARD, 2, 14, 19), (_PHONE, 3, 10, 15)):
        for m in pattern.finditer(text):
            digits = _digits(m.group())
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                found.append((*m.span(), kind))
    return sorted(found, key=lambda x: (x[0], x[2]))


def number_pieces(text: str, start: int, end: int, tails: set[str]) -> list[tuple[int, int]]:
    """The run itself where it has 7 to 19 digits. A longer one is cut between its groups of digits: what ends a base
    match (tails) is a piece, and the groups between such pieces are taken together up to 19 digits."""
    groups = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", text[start:end])]
    if sum(b - a for a, b in groups) <= 19:
        return [(start, end)] if sum(b - a for a, b in groups) >= 7 else []

    def known(i: int) -> int:
        """The group after the longest piece from group i that ends a base match, or i."""
        digits, best = "", i
        for j in range(i, len(groups)):
            digits += text[slice(*groups[j])]
            if len(digits) > 19:
                break
            if digits in tails:
                best = j + 1
        return best

    pieces, rest, i = [], [], 0
    for i in range(len(groups) + 1):
        if pieces and i < pieces[-1][1]:
            continue
        after = known(i) if i < len(groups) else i
        full = i == len(groups) or sum(b - a for a, b in groups[i : i + 1] + [groups[x] for x in rest]) > 19
        if rest and (after > i or full):
            pieces.append((rest[0], i))
            rest = []
        if after > i:
            pieces.append((i, after))
        elif i < len(groups):
            rest.append(i)
    found = []
    for i, j in pieces:
        a, b = groups[i][0], groups[j - 1][1]
        if 7 <= len(_digits(text[a:b])) <= 19:
            while a > start and text[a - 1] in "(+":
                a -= 1
            found.append((a, b))
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, base kind or -1): the nodes. A segment that overlaps a base span is left to it."""
    taken = sorted((a, b) for a, b, _ in base)
    ends = [a for a, _ in taken]
    longest, high = [], 0
    for _, b in taken:
        high = max(high, b)
        longest.append(high)
    found = []
    def add(a: int, b: int) -> None:
        at = bisect.bisect_left(ends, b)
        if not at or longest[at - 1] <= a:
            found.append((a, b, -1))

    tails = {d[i:] for a, b, k in base if k > 0 for d in [_digits(text[a:b])[-19:]] for i in range(len(d) - 7)}
    for m in _NUMBERS.finditer(text):
        for a, b in number_pieces(text, *m.span(), tails):
            add(a, b)
    for a, b in written_addresses(text):
        add(a, b)
    names = {text[a:b].partition("@")[0].lower() for a, b, k in base if k == 0}
    names = {n for n in names if len(n) >= 5 and any(not c.isalpha() for c in n)}
    if names:
        for m in _NAME.finditer(text):
            if m.group().lower() in names and not text[m.end() : m.end() + 1] == "@":
                add(*m.span())
    nodes, last = list(base), -1
    for a, b, k in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if a >= last:
            nodes.append((a, b, k))
            last = b
    return sorted(nodes)


def skip_key(text: str) -> str:
    """What mentions of the same thing share."""
    head = re.split(r" ?(?:@|\(at\)|\[at\])", text)[0]
    if any(c.isalpha() for c in head):
        return head.lower()
    return _digits(text)[-8:]


def features(text: str, node: tuple[int, int, int]) -> np.ndarray:
    a, b, kind = node
    own, x = text[a:b], np.zeros(24)
    digits = _digits(own)
    parts = re.findall("[0-9]+", own)
    x[0] = 1
    x[1:5] = [kind == k for k in range(4)]
    x[5] = own.startswith("+")
    x[6] = "(" in own
    x[7] = "@" in own
    x[8] = "at)" in own or "at]" in own
    x[9] = any(c.isalpha() for c in own)
    x[10] = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    x[11] = own.count(".") == 3
    x[12] = 14 <= len(digits) <= 19
    x[13] = x[12] and luhn(digits)
    x[14] = 10 <= len(digits) <= 13
    x[15] = 7 <= len(digits) <= 9
    x[16] = len(parts) == 1
    x[17] = len(parts) in (3, 4)
    x[18] = len(parts) > 4
    x[19] = "-" in own
    x[20] = bool(_CUE.search(text[max(0, a - 12) : a]))
    x[21] = x[9] and not x[7] and not x[8]
    x[22] = len(parts) == 3 and [len(p) for p in parts] in ([4, 2, 2], [2, 2, 4])
    x[23] = len(digits) == 0
    return x


def edges(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between close neighbours, and a skip edge from each mention to a base match of the same key.

    That is the last one before the mention, or the first one after it if there is none before; so evidence does not
    fade with the number of mentions between. Where a key has no base match, the edge goes to the mention before.
    """
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= CHAIN_CHARS]
    keys = [skip_key(text[a:b]) for a, b, _ in nodes]
    skip, last = [], {}
    sure = {key: i for i, (key, node) in reversed(list(enumerate(zip(keys, nodes, strict=True)))) if node[2] >= 0}
    for i, (key, (_, _, kind)) in enumerate(zip(keys, nodes, strict=True)):
        other = last.get(key) if kind >= 0 else sure.get(key, last.get(key))
        if other is not None and (kind < 0 or nodes[other][2] >= 0):
            skip.append((min(i, other), max(i, other)))
        if kind >= 0:
            sure[key] = i
        if kind >= 0 or key not in sure:
            last[key] = i
    return chain, skip


def _written(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A document of the generator and its mentions with their label, in order."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9)))
    pieces: list[tuple[str, int]] = []
    beside: set[int] = set()

    def person():
        kind = rng.randrange(4)
        if kind == 0:
            local, domain = f"{word()}.{n(2)}", f"{word()}.{rng.choice(['com', 'org', 'example.net'])}"
            return 0, f"{local}@{domain}", [f"{local} (at) {domain}", f"{local} at {domain}".replace(" at ", "[at]"), local]
        if kind == 1:
            p = [str(rng.randint(1, 255)) for _ in range(4)]
            return 1, ".".join(p), ["-".join(p), " ".join(p)]
        if kind == 2:
            d = rng.choice("3456") + n(14)
            d = next(d + c for c in "0123456789" if luhn(d + c))
            return 2, rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4))]), [".".join(d[i : i + 4] for i in range(0, 16, 4)), d[2:], d[:4] + "--" + d[4:]]
        a, b, c = n(3), n(3), n(4)
        return 3, f"+1 ({a}) {b}-{c}", [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}"]

    def bare():
        """A card's length of digits that is no card."""
        d = rng.choice("123456789") + n(rng.randint(13, 18))
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)

    for _ in range(rng.randint(0, 3)):
        kind, full, others = person()
        if kind == 0 and rng.random() < 0.4:  # only written out, one to three times
            pieces += [(rng.choice(others[:2]).replace(".", rng.choice([".", " (dot) "]) if rng.random() < 0.3 else "."), 1) for _ in range(rng.randint(1, 3))]
            continue
        if kind == 2 and rng.random() < 0.3:  # beside another long number: the base pattern takes both as one and drops it
            pieces += [(full.replace(" ", ""), 3), (bare(), 0)] if rng.random() < 0.5 else [(full.replace(" ", ""), 3)] * 2
            beside.add(len(pieces) - 2)
            continue
        for _ in range(rng.randint(1, 2)):
            pieces.append((full, kind + 1))
        pieces += [(rng.choice(others), kind + 1) for _ in range(rng.randint(0, 2))]
    for _ in range(rng.randint(2, 6)):
        other = rng.choice([lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: n(rng.randint(7, 13)), lambda: f"{n(3)} {n(3)} {n(3)}", lambda: f"{n(4)}-{n(4)}-{n(4)}-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"{word()} [at] {word()}", lambda: " ".join(n(2) for _ in range(rng.randint(4, 8))), bare, bare, lambda: f'token = "{rng.randbytes(20).hex()}"'])()
        pieces += [(other, 0)] * rng.choice([1, 1, 1, 2, 5])
    groups, i = [], 0
    while i < len(pieces):
        groups.append(pieces[i : i + 1 + (i in beside)])
        i += len(groups[-1])
    rng.shuffle(groups)
    text, told = "", []
    for group in groups:
        text += " ".join(word() for _ in range(rng.randint(2, 12))) + " " + " ".join([piece for piece, _ in group]) + " "
        told += group
    return text + word() + ".", told


@functools.lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of features x labels, chain labels x labels, skip labels x labels; trained once in each process."""
    rng, k = random.Random(11), len(LABELS)
    xs, ys, chain_sum, skip_sum = [], [], [], []
    for _ in range(TRAIN_DOCUMENTS):
        text, pieces = _written(rng)
        nodes = candidates(text, base_spans(text))
        at, where = 0, []
        for piece, label in pieces:
            at = text.index(piece, at)
            where.append((at, at + len(piece), label))
            at += len(piece)
        labels = []
        for a, b, kind in nodes:
            own = next((label for s, e, label in where if a < e and s < b), 0)
            labels.append(kind + 1 if kind >= 0 else own)
        chain, skip = edges(text, nodes)
        near = np.zeros((len(nodes), 2, k))
        for which, pairs in enumerate((chain, skip)):
            for i, j in pairs:
                near[i, which, labels[j]] += 1
                near[j, which, labels[i]] += 1
        xs += [features(text, node) for node in nodes]
        ys += labels
        chain_sum += list(near[:, 0])
        skip_sum += list(near[:, 1])
    x, y, c, s = np.array(xs), np.eye(k)[ys], np.array(chain_sum), np.array(skip_sum)
    w, wc, ws = np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros((k, k))
    for _ in range(400):
        z = x @ w + c @ wc + s @ ws
        p = np.exp(z - z.max(1, keepdims=True))
        g = (y - p / p.sum(1, keepdims=True)) / len(y)
        w += 3 * (x.T @ g - 1e-4 * w)
        for m, v in ((wc, c), (ws, s)):  # both ends of an edge share one symmetric table
            d = v.T @ g
            m += 1.5 * ((d + d.T) / 2 - 1e-4 * m)
    return w, wc, ws


def marginals(text: str, nodes: list[tuple[int, int, int]], weights: tuple | None = None, use_skips: bool = True) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product with damped messages. Base matches keep their kind.

    use_skips=False leaves the skip edges out, to see what they decide.
    """
    w, wc, ws = weights or model()
    z = np.array([features(text, node) for node in nodes]) @ w
    for i, (_, _, kind) in enumerate(nodes):
        if kind >= 0:
            z[i] = -1e9  # more than the messages of any number of mentions add up to
            z[i, kind + 1] = 0
    chain, skip = edges(text, nodes)
    skip = skip if use_skips else []
    pairs = np.array(chain + skip, np.int64).reshape(-1, 2)
    tables = np.exp(np.concatenate([np.repeat(wc[None], len(chain), 0), np.repeat(ws[None], len(skip), 0)]))
    src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    tables = np.concatenate([tables, tables])  # symmetric
    back = (np.arange(len(src)) + len(pairs)) % max(1, len(src))
    log = np.zeros((len(src), z.shape[1]))
    for _ in range(ROUNDS if len(src) else 0):
        total = z.copy()
        np.add.at(total, dst, log)
        belief = total[src] - log[back]
        out = np.einsum("el,elm->em", np.exp(belief - belief.max(1, keepdims=True)), tables)
        new = np.log(out / out.sum(1, keepdims=True))
        still = np.abs(new - log).max() < SETTLED
        log = 0.5 * log + 0.5 * new
        if still:
            break
    np.add.at(z, dst, log)
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(text: str | None, weights: tuple | None = None, use_skips: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, each (start, end, kind) by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    nodes = candidates(text, base)
    if len(nodes) == len(base):  # no candidate to decide
        return base, base
    p = marginals(text, nodes, weights, use_skips)
    best = p[:, 1:].argmax(1)
    more = [(a, b, int(best[i])) for i, (a, b, kind) in enumerate(nodes) if kind < 0 and p[i, 1 + best[i]] >= THRESHOLD]
    return base, sorted(base + more, key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def _find(weights: tuple):
    def run(batches):
        for batch in tk.slices(batches):
            done = [find(t, weights) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == x for _, _, x in base) for base, _ in done], pa.int64()) for k in range(len(KINDS))]
            base, spans = ([joined(x[i]) for x in done] for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(spans, pa.string())], names=["id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans), a row for each row of docs, in one pass.

    base and spans are kind:start:end in code points, by start and kind, joined by commas; the counts are of base.
    Null and empty texts have none. Null and repeated ids pass through, extra columns are ignored, an empty table
    gives an empty result. Long texts are read whole, in time linear in their length. Where two kinds tie in a
    candidate's marginal, the first of KINDS is taken.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInArrow(tk.released(_find(model())), f"id long, {counts}, base string, spans string").withColumnRenamed("id", id_col)


def mask(text: str | None, weights: tuple | None = None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in find(text, weights)[1]:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data of text_col masked; all columns, extra ones too, stay in place.

    Null stays null, empty texts stay empty, repeated rows are masked alike, an empty table stays empty.
    """
    at, weights = docs.columns.index(text_col), model()

    def run(batches):
        for batch in tk.slices(batches, text_col):
            own = pa.array([mask(t, weights) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([own if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(tk.released(run), docs.withColumn(text_col, F.col(text_col).cast("string")).schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
