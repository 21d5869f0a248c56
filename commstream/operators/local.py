"""Movement, refinement, aggregation and maintenance of small graphs in one task, by the rules of the distributed ones.

A graph of a checked size (RunConfig.local_edges) is cheaper to settle in arrays than in rounds of jobs; supergraphs
shrink from level to level, so the upper levels of any graph end here. Results equal those of the distributed rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from commstream.config import InvalidInput, Mode, NotSettled, RunConfig
from commstream.functions.gain import fits

EDGES, MAPPING, SUBS, ROUNDS, DELTA, VERTICES, PARTITION, SUMMARY, FAILED = range(9)
TABLE = "level int, kind int, a long, b long, w long"
#: Arcs that are looked at together, and rows handed on together.
BLOCK, PIECE = 1 << 18, 500_000
#: Communities to which the weight of every vertex is kept, at most.
LARGE = 8


@dataclass
class Arcs:
    """Adjacency by row: the arcs of vertex i are those from start[i] to start[i + 1] of col and weight."""

    start: np.ndarray
    col: np.ndarray
    weight: np.ndarray

    def of(self, rows: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray]:
        """Positions of the arcs of rows (ascending), one row after another, and how many each has."""
        low = self.start[rows]
        n = self.start[rows + 1] - low
        if len(rows) and rows[-1] - rows[0] == len(rows) - 1:
            return slice(int(low[0]), int(low[-1] + n[-1])), n
        return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n), n

    def blocks(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """rows in runs of about BLOCK arcs, so that what is made of them stays in the processor's cache."""
        ends = np.cumsum(self.start[rows + 1] - self.start[rows])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            yield rows[at:to]
            at = to

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1, dtype=np.int32), np.diff(self.start))

    def where(self, keep: np.ndarray) -> Arcs:
        return Arcs(np.concatenate([[0], np.cumsum(keep)])[self.start], self.col[keep], self.weight[keep])


@dataclass
class Graph:
    """Edges by position of their ends in v, which is sorted; arcs both ways without self-loops; degrees."""

    v: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    w: np.ndarray

    def __post_init__(self):
        other, n = self.src != self.dst, len(self.v)
        src, dst, w = self.src[other], self.dst[other], narrowed(self.w[other])
        key, w, low, bits = packed(np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w]), n)
        key, w = in_order(key, w, bits)
        start = np.append(np.searchsorted(key, np.arange(n, dtype=key.dtype) << key.dtype.type(low)), len(key))
        key &= key.dtype.type((1 << low) - 1)
        self.arcs = Arcs(start, key.astype(np.int32), narrowed(w))
        self.degree = summed(self.src, self.w, n) + summed(self.dst, self.w, n)
        self.m2 = int(2 * self.w.sum())


    @property
    def row(self) -> np.ndarray:
        return self.arcs.rows()

    @property
    def col(self) -> np.ndarray:
        return self.arcs.col

    @property
    def weight(self) -> np.ndarray:
        return self.arcs.weight


def narrowed(w: np.ndarray) -> np.ndarray:
    return w.astype(np.int32) if len(w) and 0 <= w.min() and w.max() < 1 << 31 else w


def packed(v: np.ndarray, to: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray | None, int, int]:
    """(key, w, low, bits): v and to in one number, and w too (then None) where it fits; to is below k, w not negative.

    Numbers sort many times faster than positions, and short ones faster still.
    """
    low = int(k).bit_length()
    high, bits = int(v.max(initial=0)).bit_length() + low, int(w.max(initial=0)).bit_length()
    kind = np.uint32 if high + bits <= 32 else np.int64
    key = v.astype(kind)
    key <<= kind(low)
    key |= to.astype(kind, copy=False)
    if high + bits >= 63:
        return key, w, low, 0
    key <<= kind(bits)
    key |= w.astype(kind, copy=False)
    return key, None, low, bits


def in_order(key: np.ndarray, w: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted pairs of packed() without weights, and the weights."""
    kind = key.dtype.type
    if w is not None:
        order = np.argsort(key)
        return key[order], w[order]
    key.sort()
    w = key & kind((1 << bits) - 1)
    key >>= kind(bits)
    return key, w


def apart(key: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    kind = key.dtype.type
    return (key >> kind(low)).astype(np.int64), (key & kind((1 << low) - 1)).astype(np.int64)


def summed(at: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Sums of w by position; those below 2 ** 53 are exact as doubles, which are added faster."""
    if len(w) and len(w) * max(int(w.max()), -int(w.min())) < 1 << 53:
        return np.bincount(at, w, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, at, w)
    return out


def positions(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where the values x stand in v, which is sorted and holds them."""
    if len(v) and int(v[-1]) - int(v[0]) < 4 * len(v) + 1024:
        table = np.zeros(int(v[-1]) - int(v[0]) + 1, np.int32)
        table[v - v[0]] = np.arange(len(v), dtype=np.int32)
        return table[x - v[0]]
    return np.searchsorted(v, x).astype(np.int32)


def graph_of(edges: pd.DataFrame, v: np.ndarray) -> Graph:
    return Graph(v, positions(v, edges["src"].to_numpy()), positions(v, edges["dst"].to_numpy()), edges["w"].to_numpy(np.int64))


def placed(table: pd.DataFrame, v: np.ndarray, column: str) -> np.ndarray:
    """The column of each vertex of v; the vertex itself where the table does not have it."""
    return table.set_index("v")[column].reindex(v).fillna(pd.Series(v, v)).to_numpy(np.int64) if len(table) else v.copy()


def compress(edges: pd.DataFrame) -> pd.DataFrame:
    lo, hi = np.minimum(edges["src"], edges["dst"]), np.maximum(edges["src"], edges["dst"])
    out = pd.DataFrame({"src": lo, "dst": hi, "w": edges["w"]}, dtype=np.int64).groupby(["src", "dst"], as_index=False)["w"].sum()
    return out[out["w"] != 0].reset_index(drop=True)


def changed_by(edges: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
    """compress() of both, where each is compressed already; delta is small, so most edges are left as they are."""
    near = np.isin(edges["src"], delta["src"].unique())
    return pd.concat([edges[~near], compress(pd.concat([edges[near], delta]))], ignore_index=True)


def runs(x: np.ndarray) -> np.ndarray:
    """Positions where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def best_of(v: np.ndarray, cur: np.ndarray, cand: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each vertex's move of largest positive gain, ties to the smallest candidate; rows come by vertex and candidate."""
    up = np.flatnonzero(gain > 0)
    first = runs(v[up])
    if not len(up):
        return v[up], cur[up], cand[up], gain[up]
    most = np.maximum.reduceat(gain[up], first)
    up = up[gain[up] == np.repeat(most, np.diff(np.append(first, len(up))))]
    up = up[runs(v[up])]
    return v[up], cur[up], cand[up], gain[up]


def firsts(c: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each c the row that is smallest by keys: sorted distinct c and positions."""
    order = np.lexsort((*reversed(keys), c))
    first = np.concatenate([[True], c[order][1:] != c[order][:-1]]) if len(c) else np.zeros(0, bool)
    return c[order][first], order[first]


def accepted(v, cur, cand, gain, k: int, by_role: bool) -> np.ndarray:
    """Which of the best moves go together: by role of the communities, or disjoint."""
    c, who, role = np.concatenate([cur, cand]), np.concatenate([v, v]), np.repeat([0, 1], len(v))
    own, at = firsts(c, -np.concatenate([gain, gain]), who, role)
    held = np.full(k, -1)
    held[own] = role[at] if by_role else who[at]
    return (held[cur] == 0) & (held[cand] == 1) if by_role else (held[cur] == v) & (held[cand] == v)


def before(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sum of d over the earlier rows of the same c."""
    order = np.argsort(c, kind="stable")
    total, first = np.cumsum(d[order]) - d[order], runs(c[order])
    out = np.empty(len(c), np.int64)
    out[order] = total - np.repeat(total[first], np.diff(np.append(first, len(c))))
    return out


def sure(v, cur, cand, gain, d, tried: np.ndarray, num: int) -> np.ndarray:
    """Of the tried moves those that gain by themselves even after all better ones at their communities."""
    order = np.flatnonzero(tried)
    order = order[np.lexsort((v[order], -gain[order]))]
    d = d[order]
    out = np.zeros(len(v), bool)
    out[order] = gain[order] > num * d * (before(cur[order], d) + before(cand[order], d))
    return out


def squares(g: Graph, c: np.ndarray, k: int) -> int:
    d = summed(c, g.degree, k)
    return int((d * d).sum())


def quality(g: Graph, c: np.ndarray, k: int, config: RunConfig) -> int:
    """Modularity times den * M^2."""
    return config.gamma_den * g.m2 * 2 * int(g.w[c[g.src] == c[g.dst]].sum()) - config.gamma_num * squares(g, c, k)


def near_sums(v: np.ndarray, to: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, to, summed w) of distinct pairs, by v and to; to is below k, w is not negative."""
    key, w, low, bits = packed(v, to, w, k)
    if not len(key):
        return v, to, np.zeros(0, np.int64)
    key, w = in_order(key, w, bits)
    first = runs(key)
    return *apart(key[first], low), np.add.reduceat(w, first, dtype=np.int64)


@dataclass
class Ties:
    """What rounds of movement know of each vertex (where known): the weight to its own community and to large ones,
    exact, and a bound of the score of any other one. Who cannot gain by that need not be looked at.

    rest: that bound less cost * drift; drift: summed over rounds, the most that a community not large lost of held.
    """

    known: np.ndarray
    inside: np.ndarray
    rest: np.ndarray
    large: dict[int, np.ndarray]
    is_large: np.ndarray
    held: np.ndarray
    drift: int = 0

    @classmethod
    def none(cls, n: int, held: np.ndarray) -> Ties:
        return cls(np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), {}, np.zeros(len(held), bool), held)

    def advance(self, held: np.ndarray, m2: int) -> None:
        """Communities have what held says now; who has much becomes large, and then all is to be seen anew."""
        new = np.flatnonzero((held > m2 // 16) & ~self.is_large)[: LARGE - len(self.large)]
        self.drift += int((self.held - held)[~self.is_large].max(initial=0))
        if len(new) or self.drift > m2 // 4:
            self.known[:], self.drift = False, 0
        self.large |= {int(h): np.zeros(len(self.known), np.int64) for h in new}
        self.is_large[new], self.held = True, held

    def follow(self, near: np.ndarray, c: np.ndarray, left: np.ndarray, to: np.ndarray, w: np.ndarray, factor: int) -> None:
        """Neighbours of movers, their communities, those that the movers left and went to, and the weights between."""
        w = w.astype(np.int64)
        for table, own in ((self.inside, c), *((t, h) for h, t in self.large.items())):
            np.add.at(table, near[to == own], w[to == own])
            np.subtract.at(table, near[left == own], w[left == own])
        other = (c != to) & ~self.is_large[to]
        v, _, more = near_sums(near[other], to[other], w[other], len(self.held))
        first = runs(v)
        if len(v):
            self.rest[v[first]] += factor * np.maximum.reduceat(more, first)

    def note(self, rows: np.ndarray, inside: np.ndarray, rest: np.ndarray, cost: np.ndarray) -> None:
        """What is seen of rows; a community without a tie has a score of 0 less cost * held."""
        least = int(self.held[(self.held > 0) & ~self.is_large].min(initial=int(self.held.sum())))
        self.known[rows], self.inside[rows] = True, inside
        self.rest[rows] = np.maximum(rest, -cost * least) - cost * self.drift

    def hopeful(self, rows: np.ndarray, c: np.ndarray, factor: int, cost: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Those of rows that may gain."""
        most = self.rest[rows] + cost[rows] * self.drift
        for h, table in self.large.items():
            score = factor * table[rows] - cost[rows] * self.held[h]
            most = np.where(c[rows] == h, most, np.maximum(most, score))
        return rows[~self.known[rows] | (most - factor * self.inside[rows] + base[rows] > 0)]


def best_moves(arcs: Arcs, rows: np.ndarray, c: np.ndarray, k: int, factor: int, cost: np.ndarray, held: np.ndarray, base: np.ndarray, open_: np.ndarray | None = None, ties: Ties | None = None) -> tuple[np.ndarray, ...]:
    """(v, cur, cand, gain) of each row's move of largest positive gain, ties to the smallest candidate.

    The gain is base + factor * (weight to cand - weight to cur) - cost * held of cand; open_: communities to enter.
    What is seen of the rows is noted in ties.
    """
    there = np.zeros(k, bool)
    there[c] = True
    names = np.flatnonzero(there)
    at, n, out = (np.cumsum(there) - 1)[c].astype(np.int32), len(names), []
    held, least = held[names], np.iinfo(np.int64).min
    closed = None if open_ is None else ~open_[names]
    if ties is not None:
        big, lone = ties.is_large[names], np.iinfo(np.int64).min // 2
        for table in ties.large.values():
            table[rows] = 0
    for own in arcs.blocks(rows):
        which, size = arcs.of(own)
        to, w, cur = at[arcs.col[which]], arcs.weight[which], at[own]
        if not len(to):
            if ties is not None:
                ties.note(own, np.zeros(len(own), np.int64), np.full(len(own), lone), cost[own])
            continue
        who = np.repeat(np.arange(len(own), dtype=np.int32), size)
        if n * len(own) <= len(to):
            # Few communities: a table with a column for each. Sums below 2 ** 53 are exact.
            near = np.bincount(who.astype(np.int64) * n + to, w, n * len(own)).astype(np.int64).reshape(len(own), n)
            inside = near[np.arange(len(own)), cur]
            score = factor * near - cost[own][:, None] * held
            score[near == 0] = least
            score[np.arange(len(own)), cur] = least
            if closed is not None:
                score[:, closed] = least
            cand = score.argmax(1)
            most, line = score[np.arange(len(own)), cand], np.arange(len(own))
            if ties is not None:
                for i in np.flatnonzero(big).tolist():
                    ties.large[int(names[i])][own] = near[:, i]
                score[:, big] = least
                ties.note(own, inside, np.maximum(score.max(1), lone), cost[own])
        else:
            v, cand, w = near_sums(who, to, w, n)
            score, stays = factor * w - cost[own][v] * held[cand], cand == cur[v]
            inside = np.zeros(len(own), np.int64)
            inside[v[stays]] = w[stays]
            score[stays if closed is None else stays | closed[cand]] = least
            first = runs(v)
            if ties is not None:
                for i in np.flatnonzero(big).tolist():
                    ties.large[int(names[i])][own[v[cand == i]]] = w[cand == i]
                rest = np.full(len(own), lone)
                rest[v[first]] = np.maximum(np.maximum.reduceat(np.where(big[cand], least, score), first), lone)
                ties.note(own, inside, rest, cost[own])
            most = np.maximum.reduceat(score, first)
            hit = np.flatnonzero(score == np.repeat(most, np.diff(np.append(first, len(v)))))
            hit = hit[runs(v[hit])]
            line, cand = v[hit], cand[hit]
        there = most > least
        line, cand, most = line[there], cand[there], most[there]
        gain = most + base[own[line]] - factor * inside[line]
        up = gain > 0
        out.append((own[line[up]], names[cur[line[up]]], names[cand[up]], gain[up]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def gained(g: Graph, c: np.ndarray, v: np.ndarray, cand: np.ndarray) -> int:
    """What moving v to cand adds to the summed weight of edges inside communities."""
    after, twice = c.copy(), 0
    after[v] = cand
    moves = np.zeros(len(c), bool)
    moves[v] = True
    for own in g.arcs.blocks(np.sort(v)):
        which, n = g.arcs.of(own)
        to, w = g.arcs.col[which], g.arcs.weight[which].astype(np.int64)
        change = (np.repeat(after[own], n) == after[to]).astype(np.int64) - (np.repeat(c[own], n) == c[to])
        twice += int((change * w * (2 - moves[to])).sum())
    return twice // 2


def settle(g: Graph, c: np.ndarray, propose, config: RunConfig, throughput: bool, told: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Rounds of moves that propose(c, k, chosen) makes until there are none: communities, movers, number of rounds."""
    names, c = np.unique(c, return_inverse=True)
    k, moved, n, last = len(names), np.zeros(len(g.v), bool), 0, None
    inside = int(g.w[c[g.src] == c[g.dst]].sum()) if throughput else 0

    def quality(c, inside):
        """Modularity times den * M^2."""
        return config.gamma_den * g.m2 * 2 * inside - config.gamma_num * squares(g, c, k)

    def made(take):
        after = c.copy()
        after[v[take]] = cand[take]
        return after, inside + gained(g, c, v[take], cand[take]) if throughput else 0

    now = quality(c, inside) if throughput else 0
    while True:
        v, cur, cand, gain = propose(c, k, last)
        if not len(v):
            return names[c], np.flatnonzero(moved), n
        if config.max_iterations is not None and n >= config.max_iterations:
            raise NotSettled(told)
        n += 1
        take = accepted(v, cur, cand, gain, k, throughput)
        after, within = made(take)
        if throughput:
            then = quality(after, within)
            if then <= now:
                take = sure(v, cur, cand, gain, g.degree[v], take, config.gamma_num)
                after, within = made(take)
                then = quality(after, within)
            now = then
        c, inside, last = after, within, (v[take], cur[take], cand[take], v)
        moved[v[take]] = True


def move(g: Graph, c: np.ndarray, config: RunConfig, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Local movement from c; active: positions to look at first, None for all."""
    num, den = config.gamma_num, config.gamma_den
    ties = None

    def propose(c, k, last):
        nonlocal ties
        dc = summed(c, g.degree, k)
        factor, cost, base = den * g.m2, num * g.degree, num * g.degree * (dc[c] - g.degree)
        if last is None:
            ties = Ties.none(len(g.v), dc)
            rows = np.arange(len(g.v)) if active is None else np.sort(active)
        else:
            who, left, to, proposed = last
            look = np.zeros(len(g.v), bool)
            look[proposed] = True
            order = np.argsort(who)
            who, origin, goal = who[order], np.zeros(len(g.v), np.int64), np.zeros(len(g.v), np.int64)
            origin[who], goal[who] = left[order], to[order]
            # Following many moves costs more than looking again.
            if 4 * int((g.arcs.start[who + 1] - g.arcs.start[who]).sum()) > len(g.arcs.col):
                ties.known[:] = False
            for own in g.arcs.blocks(who):
                which, n = g.arcs.of(own)
                near, into = g.arcs.col[which], np.repeat(goal[own], n)
                look[near[c[near] != into]] = True
                if ties.known.any():
                    ties.follow(near, c[near], np.repeat(origin[own], n), into, g.arcs.weight[which], factor)
            ties.known[who] = False
            ties.advance(dc, g.m2)
            rows = ties.hopeful(np.flatnonzero(look), c, factor, cost, base)
        return best_moves(g.arcs, rows, c, k, factor, cost, dc, base, ties=ties)

    return settle(g, c, propose, config, config.mode is Mode.THROUGHPUT, "vertices are left to move")


def merge(g: Graph, s: np.ndarray, c: np.ndarray, config: RunConfig, of: np.ndarray | None = None) -> np.ndarray:
    """Lone vertices into well tied sub-communities of their community."""
    num, den = config.gamma_num, config.gamma_den
    _, community = np.unique(c, return_inverse=True)
    whole = summed(community, g.degree, int(community.max()) + 1 if len(community) else 0)
    row = g.arcs.rows()
    same = community[row] == community[g.arcs.col]
    arcs, row = g.arcs.where(same), row[same]
    may = np.ones(len(g.v), bool)
    if of is not None:
        may[:] = False
        may[of] = True

    def propose(s, k, last):
        ds, out = summed(s, g.degree, k), s[row] != s[arcs.col]
        cut = summed(s[row[out]], arcs.weight[out], k)
        dc = np.zeros(k, np.int64)
        dc[s] = whole[community]
        tied = den * g.m2 * cut >= num * ds * (dc - ds)
        alone = (np.bincount(s, minlength=k) == 1)[s] & may
        return best_moves(arcs, np.flatnonzero(alone), s, k, den * g.m2, num * g.degree, ds, np.zeros(len(g.v), np.int64), tied)

    return settle(g, s, propose, config, True, "lone vertices are left to merge")[0]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each one reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            return label
        label = new


def split(g: Graph, s: np.ndarray, c: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sub-communities after splitting disconnected ones that hold a vertex of ``of``, and the vertices with a new id."""
    touched = np.isin(s, s[of])
    held = touched[g.src] & touched[g.dst] & (s[g.src] == s[g.dst]) & (c[g.src] == c[g.dst])
    piece = components(len(g.v), g.src[held], g.dst[held])
    roots, size = np.unique(piece[touched], return_counts=True)
    _, at = firsts(s[roots], -size, roots)
    rest = np.delete(roots, at)
    ceiling = int(max(s.max(), g.v.max())) if len(s) else 0
    new = np.zeros(len(g.v), np.int64)
    new[rest] = ceiling + 1 + np.arange(len(rest))
    parted = touched & (new[piece] > 0)
    return np.where(parted, new[piece], s), np.flatnonzero(parted)


def lifted(g: Graph, s: np.ndarray) -> pd.DataFrame:
    names, at = np.unique(s, return_inverse=True)
    a, b = at[g.src].astype(np.int32), at[g.dst].astype(np.int32)
    src, dst, w = near_sums(np.minimum(a, b), np.maximum(a, b), g.w, len(names))
    return pd.DataFrame({"src": names[src], "dst": names[dst], "w": w})


def relabelled(c: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    """(v, c) of supervertices: the community of their members, named by its smallest supervertex."""
    out = pd.DataFrame({"v": s, "k": c}).drop_duplicates()
    out["c"] = out.groupby("k")["v"].transform("min")
    return out[["v", "c"]]


def checked(edges: pd.DataFrame, config: RunConfig) -> pd.DataFrame:
    if (edges["w"] < 0).any():
        bad = edges[edges["w"] < 0].iloc[0]
        raise InvalidInput(f"the weight of ({bad['src']}, {bad['dst']}) is {bad['w']}")
    m2 = 2 * sum(edges["w"].tolist())
    if not fits(m2, config.gamma_num, config.gamma_den):
        raise InvalidInput(f"a total weight of {m2} is too large for exact gains; use a smaller scale")
    return edges


def run_levels(edges: pd.DataFrame, mapping: pd.DataFrame, config: RunConfig, levels: int) -> list[tuple]:
    """(edges, v, c, s, rounds) of each level, from mapping (v, c) up."""
    out = []
    for _ in range(levels):
        v = np.sort(mapping["v"].to_numpy(np.int64))
        g = graph_of(checked(edges, config), v)
        c, _, rounds = move(g, placed(mapping, v, "c"), config)
        s = merge(g, v.copy(), c, config)
        out.append((edges, v, c, s, rounds))
        if len(np.unique(s)) == len(v):
            break
        mapping, edges = relabelled(c, s), lifted(g, s)
    return out


def maintain_levels(levels: list[tuple], delta: pd.DataFrame, config: RunConfig, present: np.ndarray | None = None) -> list[tuple]:
    """The levels after a weight change; levels: (edges, mapping, subs) tables. present: sorted vertices of the first
    one, None for those that it had and the ends of delta."""
    out, delta = [], compress(delta)
    for edges, mapping, subs in levels:
        edges = checked(changed_by(edges, delta), config)
        v = np.unique(np.concatenate([mapping["v"], delta["src"], delta["dst"]])) if present is None else present
        v = v.astype(np.int64)
        g, known = graph_of(edges, v), np.isin(v, subs["v"])
        start, s = placed(mapping, v, "c"), placed(subs, v, "s")
        a, b, w = np.searchsorted(v, delta["src"]), np.searchsorted(v, delta["dst"]), delta["w"].to_numpy()
        hit = ((w > 0) & (start[a] != start[b])) | ((w < 0) & (start[a] == start[b]))
        c, moved, rounds = move(g, start, config, np.unique(np.concatenate([a[hit], b[hit]])))
        loose = (w < 0) & (s[a] == s[b])
        now, parted = split(g, s, c, np.unique(np.concatenate([moved, a[loose], b[loose]])))
        now = merge(g, now, c, config, np.union1d(parted, np.flatnonzero(~known)))
        out.append((edges, v, c, now, rounds))
        changed = (s != now)[g.src] | (s != now)[g.dst]
        parts = [(s[a], s[b], w), (s[g.src[changed]], s[g.dst[changed]], -g.w[changed]), (now[g.src[changed]], now[g.dst[changed]], g.w[changed])]
        delta = compress(pd.concat([pd.DataFrame(dict(zip(("src", "dst", "w"), p, strict=True))) for p in parts]))
        present = np.unique(now)
    return out


def told(levels: list[tuple], first: int) -> Iterator[pd.DataFrame]:
    """Rows of TABLE, piece by piece: the levels, the partition of the lowest one and its quality."""

    def put(level, kind, a, b=0, w=0):
        b, w = np.broadcast_to(b, len(a)), np.broadcast_to(w, len(a))
        for at in range(0, len(a), PIECE):
            n = min(PIECE, len(a) - at)
            yield pd.DataFrame({"level": np.full(n, level, np.int32), "kind": np.full(n, kind, np.int32), "a": a[at : at + n], "b": b[at : at + n], "w": w[at : at + n]})

    for i, (edges, v, c, s, rounds) in enumerate(levels, first):
        yield from put(i, EDGES, edges["src"].to_numpy(), edges["dst"].to_numpy(), edges["w"].to_numpy())
        yield from put(i, MAPPING, v, c)
        yield from put(i, SUBS, v, s)
        yield from put(i, ROUNDS, np.array([rounds]))
    if first == 0:
        edges, v, _, _, _ = levels[0]
        found = levels[-1][2]
        for below_v, above in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
            found = found[np.searchsorted(above[1], below_v[3])]
        yield from put(0, PARTITION, v, found)
        names, c = np.unique(found, return_inverse=True)
        w, a, b = edges["w"].to_numpy(), c[positions(v, edges["src"].to_numpy())], c[positions(v, edges["dst"].to_numpy())]
        d = summed(a, w, len(names)) + summed(b, w, len(names))
        yield from put(0, SUMMARY, np.array([2 * int(w[a == b].sum())]), int((d * d).sum()), 2 * int(w.sum()))
        yield from put(1, SUMMARY, np.array([len(names)]), sum(x[4] for x in levels), len(edges))


_NAMES = {EDGES: ("src", "dst", "w"), DELTA: ("src", "dst", "w"), MAPPING: ("v", "c"), SUBS: ("v", "s"), VERTICES: ("v",)}


def _sorted_out(frames) -> dict[tuple[int, int], pd.DataFrame]:
    """Rows of TABLE by level and kind, with the columns of the kind alone."""
    held: dict[tuple[int, int], list[pd.DataFrame]] = {}
    for rows in frames:
        for key, own in rows.groupby(["level", "kind"], sort=False):
            names = _NAMES[key[1]]
            held.setdefault(key, []).append(own[["a", "b", "w"][: len(names)]].set_axis(list(names), axis=1).astype(np.int64))
    return {key: pd.concat(held.pop(key), ignore_index=True) for key in list(held)}


def task(config: RunConfig, first: int, maintains: bool):
    """A function of all rows of TABLE in one task: a run from level ``first`` on, or maintenance of those levels."""

    def run(frames):
        rows = _sorted_out(frames)

        def picked(level, kind):
            return rows.pop((level, kind), pd.DataFrame({x: np.zeros(0, np.int64) for x in _NAMES[kind]}))

        try:
            if maintains:
                n = max(level for level, _ in rows) + 1
                levels = [(picked(i, EDGES), picked(i, MAPPING), picked(i, SUBS)) for i in range(first, n)]
                present = np.sort(picked(first, VERTICES)["v"].to_numpy()) if first else None
                found = maintain_levels(levels, picked(first, DELTA), config, present)
            else:
                found = run_levels(picked(first, EDGES), picked(first, MAPPING), config, config.levels - first)
            yield from told(found, first)
        except (NotSettled, InvalidInput) as error:
            text = f"{type(error).__name__}:{error}".encode()
            yield pd.DataFrame({"level": range(len(text)), "kind": FAILED, "a": list(text), "b": 0, "w": 0})

    return run
