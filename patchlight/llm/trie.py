"""A prefix tree of ordered sets, and the join that walks it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Tokens on one edge of the tree; a walk checks its bound after each edge.
RUN = 64
#: Cells of the table in which a batch of queries looks up tokens.
CELLS = 1 << 22
#: Edges that a walk follows at once; what is beyond waits, so a walk's memory doesn't depend on the tree's width.
STEP = 1 << 14


class Trie:
    """Sets of token ranks, each ascending, as a tree of shared beginnings. Each group of sets hangs from a node of its own."""

    def __init__(self, sets: list[np.ndarray], groups: np.ndarray):
        """Sets by group (numbered from 0), and in lexicographic order within it; a set may be another's beginning."""
        self.sizes = np.array([len(s) for s in sets], np.int64)
        runs: list[np.ndarray] = []
        depth, parent, low, high, end = [], [], [], [], []

        def node(above: int, of: int, begin: int, stop: int, first: int, last: int) -> int:
            """Append the edge set[of][begin:stop] below a node, in runs; returns the last of its nodes."""
            at = above
            for b in range(begin, max(stop, begin + 1), RUN):
                e = min(b + RUN, stop)
                runs.append(sets[of][b:e])
                depth.append(e)
                parent.append(at)
                low.append(first)
                high.append(last)
                end.append(-1)
                at = len(runs) - 1
            return at

        edges = np.searchsorted(groups, np.arange(int(groups[-1]) + 2 if len(groups) else 1))
        work = []
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            # The node of a group is numbered as the group is.
            work.append((first, last, 0, node(-1, min(first, len(sets) - 1), 0, 0, first, last)))
        common = [self._shared(sets[i], sets[i + 1]) for i in range(len(sets) - 1)]
        # Each stretch of sets with a common beginning is a node; stretches nest.
        while work:
            first, last, begin, above = work.pop()
            if last <= first:
                continue
            if last - first == 1:
                end[node(above, first, begin, len(sets[first]), first, last)] = first
                continue
            inner = common[first : last - 1]
            shared = min(inner)
            at = node(above, first, begin, shared, first, last) if shared > begin else above
            starts = [first, *(first + 1 + k for k, c in enumerate(inner) if c == shared), last]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if len(sets[s]) == shared:
                    # The set ends here: a node of its own without tokens, and the rest of its stretch beside it.
                    end[node(at, s, shared, shared, s, s + 1)] = s
                    s += 1
                if s < e:
                    work.append((s, e, shared, at))
        self.depth, self.parent, self.low, self.high, self.end = (np.array(x, np.int64) for x in (depth, parent, low, high, end))
        self.run_sizes = np.array([len(r) for r in runs], np.int64)
        self.run_begin = np.concatenate([[0], np.cumsum(self.run_sizes)])
        self.tokens = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        order = np.argsort(self.parent, kind="stable")
        self.children = order
        self.child_begin = np.searchsorted(self.parent[order], np.arange(len(runs) + 1))
        self.least = np.array([self.sizes[a:b].min() if b > a else 0 for a, b in zip(low, high, strict=True)], np.int64)
        self.most = np.array([self.sizes[a:b].max() if b > a else 0 for a, b in zip(low, high, strict=True)], np.int64)

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differs = a[:n] != b[:n]
        return int(differs.argmax()) if differs.any() else n

    def walk(self, table: np.ndarray, sizes: np.ndarray, start: np.ndarray, before: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, set) that are similar enough.

        table: for each query, which tokens it has. start: the group of each query. before: only sets of lower index than this are
        sought for it. Queries that share a path through the tree share its nodes level by level; the overlap so far is carried
        along, and a subtree is left when what remains of the query and of the subtree's sets can't make up the overlap that their sizes ask for.
        """
        upto = np.cumsum(table, 1, dtype=np.int32)
        work = [(np.arange(len(table)), start, np.zeros(len(table), np.int64))]
        while work:
            query, node, overlap = work.pop()
            n = self.child_begin[node + 1] - self.child_begin[node]
            upon = np.cumsum(n)
            if len(query) > 1 and upon[-1] > STEP:
                cut = min(max(int(np.searchsorted(upon, STEP)), 1), len(query) - 1)
                work.append((query[cut:], node[cut:], overlap[cut:]))
                query, node, overlap, n, upon = query[:cut], node[:cut], overlap[:cut], n[:cut], upon[:cut]
            at = np.repeat(np.arange(len(query)), n)
            child = self.children[self.child_begin[node][at] + np.arange(len(at)) - (upon - n)[at]]
            query, overlap = query[at], overlap[at]
            keep = self.low[child] < before[query]
            query, child, overlap = query[keep], child[keep], overlap[keep]
            if not len(query):
                continue
            length = self.run_sizes[child]
            row = np.repeat(np.arange(len(child)), length)
            place = self.run_begin[child][row] + np.arange(len(row)) - (np.cumsum(length) - length)[row]
            hits = table[query[row], self.tokens[place]]
            overlap = overlap + np.bincount(row, hits, len(child)).astype(np.int64)
            last = self.tokens[np.maximum(self.run_begin[child + 1] - 1, 0)]
            gone = np.where(length > 0, upto[query, last], overlap)
            left, depth, own = sizes[query] - gone, self.depth[child], sizes[query]
            best = np.clip(depth + left, self.least[child], self.most[child])
            reach = overlap + np.minimum(best - depth, left)
            keep = reach * (100 + percent) >= percent * (own + best)
            query, child, overlap = query[keep], child[keep], overlap[keep]
            ended = self.end[child]
            own = np.flatnonzero((ended >= 0) & (ended < before[query]))
            pair_q, pair_s, o = query[own], ended[own], overlap[own]
            good = o * 100 >= percent * (sizes[pair_q] + self.sizes[pair_s] - o)
            if good.any():
                yield pair_q[good], pair_s[good]
            if len(query):
                work.append((query, child, overlap))


def similar_pairs(
    sets: list[np.ndarray], percent: int, *, groups: np.ndarray | None = None, indexed: np.ndarray | None = None, asked: np.ndarray | None = None, weigh: Callable[[np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in ``sets`` (of distinct hashes) of one group with 100 * intersection >= percent * union, each pair once, in parts.

    indexed and asked: which sets go into the tree and which are its queries; without them all are both. weigh: how common tokens are; the tree's order puts
    common ones first, ties by hash, so that it is the same in every tree if the weights are.
    """
    if not sets:
        return
    groups = np.zeros(len(sets), np.int64) if groups is None else np.unique(groups, return_inverse=True)[1]
    every = np.unique(np.concatenate(sets))
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -weigh(every).astype(np.int64))) if weigh else np.arange(len(every))] = np.arange(len(every))
    ranked = [np.sort(rank[np.searchsorted(every, s)]) for s in sets]
    both = indexed is None
    own = np.arange(len(sets)) if both else np.flatnonzero(indexed)
    order = own[sorted(range(len(own)), key=lambda k: (groups[own[k]], ranked[own[k]].astype(">i8").tobytes()))]
    if not len(order):
        return
    tree = Trie([ranked[k] for k in order], groups[order])
    queries = order if both else np.flatnonzero(asked & (groups <= groups[order[-1]]))
    step = max(1, CELLS // max(len(every), 1))
    for i in range(0, len(queries), step):
        part = queries[i : i + step]
        table = np.zeros((len(part), len(every)), bool)
        for k, s in enumerate(part):
            table[k, ranked[s]] = True
        before = np.arange(i, i + len(part)) if both else np.full(len(part), len(order))
        for a, b in tree.walk(table, np.array([len(ranked[s]) for s in part]), groups[part], before, percent):
            yield part[a], order[b]


class Least:
    """Of each of n things the smallest that links reach."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            np.minimum.at(self.of, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(further := self.of[self.of], self.of):
                self.of = further
