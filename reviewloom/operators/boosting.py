"""Boosted trees on sparse rows, fitted inside one task, or by tasks that have some features each.

Softmax boosting with one tree per class and round. A tree grows level by level; a split is searched over the
entries that exist only, sorted by feature and weight, so the cost of a level is the number of entries and not
rows times features: every term of a vocabulary can take part. Rows without the feature go to the side that
gains more. Features that cannot reach the least weight of a child on any side are passed over, which
changes no tree.
"""

from __future__ import annotations

from collections.abc import Generator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

from reviewloom.operators.peers import Alone, Peers

# Parameters of the baseline model.
BASELINE = {"learning_rate": 0.3, "max_depth": 6, "n_estimators": 100, "subsample": 1.0, "colsample_bytree": 1.0}
LAMBDA = 1.0  # added to the second derivatives of a leaf
LEAST_CHILD = 1.0  # sum of second derivatives that a child needs
LEAST_GAIN = 1e-6
CHUNK = 1 << 16  # entries searched at a time


@dataclass
class Sparse:
    """Entries (row, feature, weight), sorted by feature, then weight; features are 0, 1, ..."""

    rows: int
    row: np.ndarray
    feature: np.ndarray
    weight: np.ndarray
    names: np.ndarray  # feature -> 64-bit name

    @staticmethod
    def of(features, weights) -> "Sparse":
        """From one array of feature names and one of weights per row. Zero weights are absent."""
        sizes = np.array([len(f) for f in features], dtype=np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        name = np.concatenate([np.zeros(0, np.int64), *features]).astype(np.int64)
        weight = np.concatenate([np.zeros(0), *weights]).astype(np.float64)
        return Sparse.long(len(sizes), row, name, weight)

    @staticmethod
    def long(rows: int, row: np.ndarray, name: np.ndarray, weight: np.ndarray) -> "Sparse":
        """From the entries of ``rows`` rows, in any order."""
        there = weight != 0
        names, feature = np.unique(name[there], return_inverse=True)
        row, weight = row[there], weight[there]
        order = np.lexsort((row, weight, feature))
        return Sparse(rows, row[order].astype(np.int32), feature[order].astype(np.int32), weight[order], names)

    def part(self, keep: np.ndarray) -> "Sparse":
        """The rows where ``keep`` is true, numbered anew; features keep their numbers."""
        number = np.cumsum(keep) - 1
        inside = keep[self.row]
        return Sparse(int(keep.sum()), number[self.row[inside]].astype(np.int32), self.feature[inside], self.weight[inside], self.names)


@dataclass
class Trees:
    """Nodes of all trees, children by place. ``feature`` is a 64-bit name; leaves have ``left`` -1."""

    classes: int
    rounds: int
    tree: np.ndarray  # first node of each tree; round r, class c is tree r * classes + c
    feature: np.ndarray
    threshold: np.ndarray
    absent_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def used(self) -> np.ndarray:
        return np.unique(self.feature[self.left >= 0])

    def margins(self, data: Sparse, rounds: int | None = None, block: int = 256) -> np.ndarray:
        """Row x class sums of leaf values over the first ``rounds`` rounds."""
        rounds = self.rounds if rounds is None else rounds
        roots = self.tree[: rounds * self.classes]
        used = self.used()
        found = np.zeros((data.rows, self.classes))
        # Columns of the features that any split reads; the last one is always absent.
        place = np.searchsorted(used, data.names)
        known = (place < len(used)) & (used[np.minimum(place, max(0, len(used) - 1))] == data.names) if len(used) else np.zeros(len(data.names), bool)
        column = np.where(known, place, len(used))[data.feature]
        order = np.argsort(data.row, kind="stable")
        starts = np.searchsorted(data.row[order], np.arange(data.rows + 1))
        at_column = np.searchsorted(used, self.feature)
        for first in range(0, data.rows, block):
            last = min(data.rows, first + block)
            own = order[starts[first] : starts[last]]
            dense = np.full((last - first, len(used) + 1), np.nan)
            dense[data.row[own] - first, column[own]] = data.weight[own]
            dense[:, len(used)] = np.nan
            node = np.broadcast_to(roots, (last - first, len(roots))).copy()
            rows = np.arange(last - first)[:, None]
            while True:
                inner = self.left[node] >= 0
                if not inner.any():
                    break
                x = dense[rows, np.where(inner, at_column[node], len(used))]
                left = np.where(np.isnan(x), self.absent_left[node], x <= self.threshold[node])
                node = np.where(inner, np.where(left, self.left[node], self.right[node]), node)
            found[first:last] = self.value[node].reshape(last - first, -1, self.classes).sum(axis=1)
        return found

    def rows(self) -> list[dict]:
        """The nodes as rows, to be stored."""
        names = ("feature", "threshold", "absent_left", "left", "right", "value")
        return [{"node": i, **{n: getattr(self, n)[i].item() for n in names}} for i in range(len(self.left))]


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Softmax per row."""
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(data: Sparse, labels: np.ndarray, classes: int, params: Mapping[str, float] | None = None, seed: int = 42, threads: int = 1, peers: Alone | Peers | None = None) -> Trees:
    """Softmax boosting; ``labels`` are 0 .. ``classes`` - 1. Without rows the trees are single leaves of value 0.

    The trees of a round are independent and may grow in ``threads``; their number changes nothing else. With ``peers`` the
    features are dealt to tasks in the order of their names, and every task has all rows' labels and gets all trees.
    """
    return fit_and_hold(data, labels, classes, params, seed, threads, peers=peers)[0]


def fit_and_hold(
    data: Sparse,
    labels: np.ndarray,
    classes: int,
    params: Mapping[str, float] | None = None,
    seed: int = 42,
    threads: int = 1,
    held: np.ndarray | None = None,
    stops: Sequence[int] = (),
    peers: Alone | Peers | None = None,
) -> tuple[Trees, dict[int, np.ndarray]]:
    """``fit`` on the rows that are not ``held``, and the margins of the held ones after each of ``stops`` rounds."""
    p, peers = {**BASELINE, **(params or {})}, peers or Alone()
    rounds, draw = int(p["n_estimators"]), np.random.default_rng(seed)
    train = np.ones(data.rows, dtype=bool) if held is None else ~held
    wanted = np.eye(classes)[labels] if data.rows else np.zeros((0, classes))
    margin, margins = np.zeros((data.rows, classes)), {}
    # A second derivative is at most 1/2, so a feature of fewer rows never makes a child.
    count = np.bincount(data.feature[train[data.row]], minlength=len(data.names))
    seen = np.flatnonzero(count)
    own = peers.gather(len(seen))
    first, total = sum(own[: peers.place]), sum(own)
    kept = (count * 0.5 >= LEAST_CHILD)[data.feature]
    data = Sparse(data.rows, data.row[kept], data.feature[kept], data.weight[kept], data.names)
    builder = _Builder(data, int(p["max_depth"]), float(p["learning_rate"]))

    with ThreadPoolExecutor(max(1, min(threads, classes))) as pool:
        for n in range(1, rounds + 1):
            share, jobs = probabilities(margin) if data.rows else margin, []
            for c in range(classes):
                g, h = share[:, c] - wanted[:, c], np.maximum(2 * share[:, c] * (1 - share[:, c]), 1e-16)
                inside = train.copy()
                if p["subsample"] < 1:
                    inside[train] = draw.random(int(train.sum())) < p["subsample"]
                taken = np.ones(len(data.names), dtype=bool)
                if p["colsample_bytree"] < 1:
                    out = draw.permutation(total)[max(1, int(total * p["colsample_bytree"])) :] - first
                    taken[seen[out[(out >= 0) & (out < len(seen))]]] = False
                jobs.append(builder.grow(g, h, inside, taken))
            for c, (nodes, values) in enumerate(_side_by_side(jobs, peers, pool)):
                margin[:, c] += values
                builder.add(nodes)
            if n in stops:
                margins[n] = margin[~train]
    return builder.trees(classes, rounds), margins


def _side_by_side(jobs: Sequence[Generator], peers: Alone | Peers, pool: ThreadPoolExecutor) -> list:
    """The results of growing trees, which take turns at the same time; what they say goes to the peers together."""
    results, heard = [None] * len(jobs), {i: None for i in range(len(jobs))}

    def turn(i: int):
        try:
            return i, False, jobs[i].send(heard[i])
        except StopIteration as ended:
            return i, True, ended.value

    while heard:
        said = {}
        for i, over, value in pool.map(turn, list(heard)):
            if over:
                results[i] = value
            else:
                said[i] = value
        everyone = peers.gather(said) if said else []
        heard = {i: [peer[i] for peer in everyone] for i in said}
    return results


class _Builder:
    """Grows trees over the same rows and keeps their nodes."""

    def __init__(self, data: Sparse, depth: int, rate: float):
        self.data, self.depth, self.rate = data, depth, rate
        self.first: list[int] = []
        self.nodes: list[tuple] = []  # feature, threshold, absent_left, left, right, value
        # Whole features at a time, of about CHUNK entries.
        sizes = np.bincount(data.feature, minlength=len(data.names))
        ends = np.cumsum(sizes)
        self.begin = ends - sizes
        last = np.flatnonzero(np.diff(ends // CHUNK, append=-1) != 0)
        self.chunks = [slice(a, b) for a, b in zip([0, *ends[last[:-1]].tolist()], ends[last].tolist()) if b > a]
        self.ends = ends

    def trees(self, classes: int, rounds: int) -> Trees:
        columns = list(zip(*self.nodes))
        kinds = (np.int64, np.float64, bool, np.int64, np.int64, np.float64)
        return Trees(classes, rounds, np.array(self.first, dtype=np.int64), *(np.array(c, dtype=k) for c, k in zip(columns, kinds)))

    def add(self, nodes: list[tuple]) -> None:
        """One more tree, whose nodes are numbered from 0."""
        root = len(self.nodes)
        self.first.append(root)
        self.nodes += [(f, t, a, left + root if left >= 0 else -1, right + root if right >= 0 else -1, v) for f, t, a, left, right, v in nodes]

    def grow(self, g: np.ndarray, h: np.ndarray, inside: np.ndarray, taken: np.ndarray) -> Generator:
        """A tree's nodes, and each row's leaf value, that of rows that were not drawn too.

        Says twice a level, and gets what all peers say: the best gain of each open node, then the split of each node
        whose best gain is among its own features, with the side of every row of the node.
        """
        data = self.data
        nodes: list[tuple] = [(0, 0.0, False, -1, -1, 0.0)]
        node = np.zeros(data.rows, dtype=np.int32)
        heavy = np.bincount(data.feature, weights=np.where(inside, h, 0)[data.row], minlength=len(data.names)) >= LEAST_CHILD
        usable, every = taken & heavy, bool(inside.all())
        entries = []
        for chunk in self.chunks:
            there = usable[data.feature[chunk]]
            entries.append((np.flatnonzero(there if every else there & inside[data.row[chunk]]) + chunk.start).astype(np.int64))
        open_ = [0]
        for level in range(self.depth + 1):
            sums = self._sums(node, g, h, inside, open_)
            # Nodes that are too light for two children are leaves.
            able = np.array([hs >= 2 * LEAST_CHILD for _, hs in sums])
            splits = {}
            if level < self.depth and able.any():
                low = open_[0]
                tops, found = np.full(len(open_), -np.inf), []
                for i, some in enumerate(entries):
                    entries[i], cuts = self._search(some, node, g, h, low, able, sums)
                    found.append(None if cuts is None else cuts.tops)
                    if cuts is not None:
                        np.maximum.at(tops, *cuts.tops)
                tops = np.max((yield tops), axis=0)
                # The first of nearly equal gains, so that the order of a sum decides nothing.
                least = np.where(tops > LEAST_GAIN, tops - 1e-9 * np.maximum(1.0, np.abs(tops)), np.inf)
                offers: dict[int, tuple] = {}
                for some, best in zip(entries, found):
                    mine = [] if best is None else [n for n, top in zip(*(b.tolist() for b in best)) if top >= least[n] and n + low not in offers]
                    if mine:
                        cuts = self._search(some, node, g, h, low, able, sums)[1]
                        for n in mine:
                            feature, threshold, absent_left = cuts.first(n, least[n], data)
                            offers[n + low] = (int(data.names[feature]), threshold, absent_left, self._sides(node, n + low, feature, threshold, absent_left))
                for told in (yield offers):
                    splits = {**told, **splits}  # features come in the order of the tasks
            following = []
            for place, (gs, hs) in zip(open_, sums):
                if place not in splits:
                    nodes[place] = (0, 0.0, False, -1, -1, -gs / (hs + LAMBDA) * self.rate)
                    continue
                name, threshold, absent_left, sides = splits[place]
                left = len(nodes)
                nodes += [(0, 0.0, False, -1, -1, 0.0)] * 2
                nodes[place] = (name, threshold, absent_left, left, left + 1, 0.0)
                own = np.flatnonzero(node == place)
                node[own] = np.where(np.unpackbits(sides, count=len(own)), left, left + 1)
                following += [left, left + 1]
            if not following:
                break
            open_ = following  # nodes of a level lie together, behind all others
        return nodes, np.array([n[5] for n in nodes])[node]

    @staticmethod
    def _sums(node, g, h, inside, open_):
        at = node - open_[0]
        live = inside & (at >= 0)
        gs = np.bincount(at[live], weights=g[live], minlength=len(open_))
        hs = np.bincount(at[live], weights=h[live], minlength=len(open_))
        return list(zip(gs.tolist(), hs.tolist()))

    def _sides(self, node, place, feature, threshold, absent_left) -> np.ndarray:
        """Of each row of a node, whether it goes left, as bits."""
        own = np.flatnonzero(node == place)
        left = np.full(len(own), absent_left)
        span = slice(self.begin[feature], self.ends[feature])
        row, weight = self.data.row[span], self.data.weight[span]
        mine = node[row] == place
        left[np.searchsorted(own, row[mine])] = weight[mine] <= threshold
        return np.packbits(left)

    def _search(self, e, node, g, h, low, able, sums) -> tuple[np.ndarray, "_Cuts | None"]:
        """The entries that can matter further down, those of a node and feature that are heavy enough for a child, sorted
        by node, feature and weight; and the cuts between them."""
        data = self.data
        row = data.row.take(e)
        at = node.take(row)
        at -= low
        if len(able) > 1:  # entries of other nodes go to the end
            at[(at < 0) | ~able.take(np.maximum(at, 0))] = len(able)
            order = np.argsort(at.astype(np.int16) if len(able) < 1 << 15 else at, kind="stable")
            at = at.take(order)
            alive = np.searchsorted(at, len(able))
            at, order = at[:alive], order[:alive]
            e, row = e.take(order), row.take(order)
        if not len(e):
            return e, None
        feature, weight_h = data.feature.take(e), h.take(row)
        new = np.ones(len(e), dtype=bool)
        np.not_equal(feature[1:], feature[:-1], out=new[1:])
        if len(able) > 1:
            new[1:] |= at[1:] != at[:-1]
        start = np.flatnonzero(new)
        sizes = np.diff(start, append=len(e))
        heavy = np.add.reduceat(weight_h, start) >= LEAST_CHILD
        if not heavy.all():
            kept = np.flatnonzero(np.repeat(heavy, sizes))
            e, row, at, weight_h, sizes = e.take(kept), row.take(kept), at.take(kept), weight_h.take(kept), sizes[heavy]
            if not len(e):
                return e, None
        end = np.cumsum(sizes) - 1
        weight = data.weight.take(e)
        # A cut lies behind the last of equal weights.
        last = np.empty(len(e), dtype=bool)
        np.not_equal(weight[1:], weight[:-1], out=last[:-1])
        last[end] = True
        k, each = np.flatnonzero(last), np.add.reduceat(last, end - sizes + 1, dtype=np.int64)
        sum_g, sum_h = np.cumsum(g.take(row)), np.cumsum(weight_h)
        base_g = np.concatenate(([0.0], sum_g[end[:-1]]))
        base_h = np.concatenate(([0.0], sum_h[end[:-1]]))
        seg_g, seg_h = sum_g[end] - base_g, sum_h[end] - base_h
        n = at[end].astype(np.int64)
        node_g, node_h = (np.array(x)[n] for x in zip(*sums))
        whole = np.repeat(node_g * node_g / (node_h + LAMBDA), each)
        node_g, node_h = np.repeat(node_g, each), np.repeat(node_h, each)
        gl, hl = sum_g.take(k) - np.repeat(base_g, each), sum_h.take(k) - np.repeat(base_h, each)

        def gain(gl, hl):
            gr, hr = node_g - gl, node_h - hl
            light = np.minimum(hl, hr) < LEAST_CHILD
            value = gl * gl
            value /= hl + LAMBDA
            gr *= gr
            hr += LAMBDA
            gr /= hr
            value += gr
            value -= whole
            value[light] = -np.inf
            return value

        right = gain(gl, hl)
        left = gain(node_g - (np.repeat(seg_g, each) - gl), node_h - (np.repeat(seg_h, each) - hl))
        return e, _Cuts(e, weight, end, k, np.repeat(n, each), right, left)


class _Cuts:
    """Cuts of some features, by node, feature and weight, with their gains when absent rows go right or left."""

    def __init__(self, e, weight, end, k, n, right, left):
        self.e, self.weight, self.end, self.k, self.right, self.left = e, weight, end, k, right, left
        self.best = np.maximum(right, left)
        self.starts = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
        self.tops = n[self.starts], np.maximum.reduceat(self.best, self.starts)  # nodes, and the best gain of each

    def first(self, n: int, least: float, data: Sparse) -> tuple[int, float, bool]:
        """Feature, threshold, and whether absent rows go left, of the first cut of node ``n`` that gains ``least``."""
        i = self.starts[np.searchsorted(self.tops[0], n)]
        i += int(np.argmax(self.best[i:] >= least))
        j = self.k[i]
        closing = self.end[np.searchsorted(self.end, j)] == j
        threshold = np.inf if closing else (self.weight[j] + self.weight[j + 1]) / 2
        return int(data.feature[self.e[j]]), float(threshold), bool(self.left[i] > self.right[i] + 1e-9 * max(1.0, abs(self.best[i])))
