"""Signature trees over sets of hashes and their dual traversal, many trees at a time.

A leaf is a set: a bitmap of its hashes and its size. A node holds the OR of its children's bitmaps, the range of their
sizes, the most hashes that a set below has beyond one per bit, and the component of its sets where they have one.
Sets of one power of two in size make the trees of one bitmap width, ordered so that sets of like size that share
hashes stand side by side.

The traversal starts with pairs of roots. A pair of nodes is left out if no sets below them can overlap enough: common bits
plus hashes beyond one per bit, or the sizes, are too small. It is left out too if all sets below are in one component
already. Pairs of leaves that are left are compared on the whole sets; each link joins two components at once, so a
group of near copies of any size takes a number of comparisons in line with its size.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: Pairs of nodes that are looked at together, and bytes of bitmaps.
CHUNK, CHUNK_BYTES = 4096, 1 << 22


def links(a: int, b: int, both: int) -> bool:
    """Jaccard similarity of 3/4 and more of sets of sizes a and b with so many common members."""
    return 100 * both >= 75 * (a + b - both)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def _starts(parts: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))


class Level:
    """Nodes of one height of all trees of one bitmap width."""

    def __init__(self, tree, bits, low, high, excess, first, last):
        self.tree, self.bits, self.low, self.high, self.excess = tree, bits, low, high, excess
        self.first, self.last = first, last  # children, in the level below
        self.folded = None

    def half(self) -> np.ndarray:
        if self.folded is None:
            w = self.bits.shape[1] // 2
            self.folded = self.bits[:, :w] | self.bits[:, w:]
        return self.folded


def grow(tree: np.ndarray, bits: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Levels from the leaves up to one root per tree; leaves of a tree stand together."""
    excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    own = np.arange(len(sizes))
    levels = [Level(tree, bits, sizes, sizes, excess, own, own + 1)]
    while len(_starts(levels[-1].tree)) < len(levels[-1].tree):
        below = levels[-1]
        begin = _starts(below.tree)
        place = np.arange(len(below.tree)) - np.repeat(begin, np.diff(np.append(begin, len(below.tree))))
        first = np.flatnonzero(place % FAN == 0)
        levels.append(
            Level(
                below.tree[first],
                np.bitwise_or.reduceat(below.bits, first, axis=0),
                np.minimum.reduceat(below.low, first),
                np.maximum.reduceat(below.high, first),
                np.maximum.reduceat(below.excess, first),
                first,
                np.append(first[1:], len(below.tree)),
            )
        )
    return levels


class Forest:
    """The trees of many runs. run: which sets are to be compared; block: where a run has sets of two blocks, only
    pairs across them are."""

    def __init__(self, run: np.ndarray, block: np.ndarray, doc: np.ndarray, component: np.ndarray, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        kind = np.frexp(size.astype(float))[1] - 1  # power of two
        like = np.array([s[min(1, len(s) - 1)] for s in sets], np.uint64)
        order = np.lexsort((like, (np.log2(size) * 6).astype(int), block, run, kind))
        self.levels: dict[int, list[Level]] = {}
        self.leaves: dict[int, np.ndarray] = {}
        self.doc, self.sets = doc, sets
        self.label = np.unique(component, return_inverse=True)[1]
        self.root = np.arange(self.label.max() + 1 if len(sets) else 0)  # label -> label of the component it is in now
        self.two_blocks = np.zeros(0, bool)
        _, run = np.unique(run, return_inverse=True)
        low, high = np.full(run.max() + 1, np.iinfo(np.int64).max), np.full(run.max() + 1, -1)
        np.minimum.at(low, run, block)
        np.maximum.at(high, run, block)
        self.across = low != high
        tree = 2 * run + (block != low[run])
        for k in np.unique(kind):
            own = order[kind[order] == k]
            self.leaves[int(k)] = own
            self.levels[int(k)] = grow(tree[own], self._bitmaps(own, int(k)), size[own])

    def _bitmaps(self, own: np.ndarray, kind: int) -> np.ndarray:
        """8 to 16 bits per member, up to 2^17 in all."""
        width = min(max(64, 1 << (kind + 4)), 1 << 17)
        out = np.empty((len(own), width // 64), np.uint64)
        step = max(1, CHUNK_BYTES // width)
        for at in range(0, len(own), step):
            part = own[at : at + step]
            flags = np.zeros((len(part), width), np.uint8)
            for i, s in enumerate(part):
                flags[i, ((self.sets[s] >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
            out[at : at + step] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
        return out

    def _relabel(self) -> None:
        """The component of each node, or -1."""
        self.node_label = {}
        for k, levels in self.levels.items():
            low = high = self.root[self.label[self.leaves[k]]]
            out = [low]
            for level in levels[1:]:
                low, high = np.minimum.reduceat(low, level.first), np.maximum.reduceat(high, level.first)
                out.append(np.where(low == high, low, -1))
            self.node_label[k] = out
        self.stale = False

    def _union(self, a: int, b: int) -> bool:
        a, b = self.root[self.label[a]], self.root[self.label[b]]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
            self.stale = True
        return a != b

    def _roots(self) -> list[tuple]:
        """Pairs of trees of one run that may hold links: sizes differ by one power of two at most."""
        top = {k: levels[-1] for k, levels in self.levels.items()}
        out = []
        for k in sorted(top):
            place = {t: i for i, t in enumerate(top[k].tree.tolist())}
            for other in (k, k + 1):
                if other not in top:
                    continue
                x, y = [], []
                for i, t in enumerate(top[other].tree.tolist()):
                    if self.across[t // 2]:
                        mates = [t ^ 1] if other != k or t & 1 else []
                    else:
                        mates = [t]
                    for m in mates:
                        if m in place:
                            x.append(place[m])
                            y.append(i)
                if x:
                    out.append((k, len(self.levels[k]) - 1, np.array(x), other, len(self.levels[other]) - 1, np.array(y)))
        return out

    def _may_link(self, kx, lx, x, ky, ly, y) -> np.ndarray:
        a, b = self.levels[kx][lx], self.levels[ky][ly]
        ok = (4 * a.high[x] >= 3 * b.low[y]) & (4 * b.high[y] >= 3 * a.low[x])
        narrow, wide = a.bits, b.bits if a.bits.shape[1] == b.bits.shape[1] else b.half()
        todo = np.flatnonzero(ok)
        step = max(1, CHUNK_BYTES // (8 * narrow.shape[1]))
        for at in range(0, len(todo), step):
            part = todo[at : at + step]
            i, j = x[part], y[part]
            both = np.bitwise_count(narrow[i] & wide[j]).sum(axis=1, dtype=np.int64)
            both += np.minimum(a.excess[i], b.excess[j]) if narrow.shape[1] == b.bits.shape[1] else a.excess[i]
            most = np.minimum(np.minimum(both, a.high[i]), b.high[j])
            ok[part] = 7 * most >= 3 * (a.low[i] + b.low[j])
        return ok

    def _children(self, kx, lx, x, ky, ly, y) -> list[tuple]:
        """Pairs of children, in parts of CHUNK; the nearest ones last."""
        a, b = self.levels[kx][lx], self.levels[ky][ly]
        fx, nx = (a.first[x], a.last[x] - a.first[x]) if lx else (x, np.ones(len(x), np.int64))
        fy, ny = (b.first[y], b.last[y] - b.first[y]) if ly else (y, np.ones(len(y), np.int64))
        total = nx * ny
        of = np.repeat(np.arange(len(x)), total)
        place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        cx, cy = fx[of] + place // ny[of], fy[of] + place % ny[of]
        if kx == ky and lx == ly:
            same = (x == y)[of]
            cx, cy = cx[~same | (cx <= cy)], cy[~same | (cx <= cy)]
            near = np.argsort(cx == cy, kind="stable")
            cx, cy = cx[near], cy[near]
        lx, ly = max(0, lx - 1), max(0, ly - 1)
        return [(kx, lx, cx[i : i + CHUNK], ky, ly, cy[i : i + CHUNK]) for i in range(0, len(cx), CHUNK)]

    def search(self) -> list[tuple[int, int]]:
        """Links (smaller doc, larger doc) that connect what all links connect."""
        found = []
        first_of: dict[int, int] = {}
        for i, d in enumerate(self.doc.tolist()):  # rows of one document are one component
            self._union(first_of.setdefault(d, i), i)
        self._relabel()
        todo = self._roots()
        while todo:
            kx, lx, x, ky, ly, y = todo.pop()
            if self.stale:
                self._relabel()
            own = (x == y) & (kx == ky) & (lx == ly)
            label = self.node_label[kx][lx][x]
            keep = ~((label >= 0) & (label == self.node_label[ky][ly][y]))
            if lx == 0:
                keep &= ~own
            x, y, own = x[keep], y[keep], own[keep]
            may = own.copy()
            if not own.all():
                may[~own] = self._may_link(kx, lx, x[~own], ky, ly, y[~own])
            x, y = x[may], y[may]
            if not len(x):
                continue
            if lx or ly:
                todo += self._children(kx, lx, x, ky, ly, y)
                continue
            for i, j in zip(self.leaves[kx][x].tolist(), self.leaves[ky][y].tolist(), strict=True):
                if self.root[self.label[i]] == self.root[self.label[j]]:
                    continue
                s, t = self.sets[i], self.sets[j]
                if links(len(s), len(t), common(s, t)):
                    self._union(i, j)
                    a, b = int(self.doc[i]), int(self.doc[j])
                    found.append((min(a, b), max(a, b)))
        return found
