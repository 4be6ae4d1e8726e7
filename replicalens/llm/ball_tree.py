"""Exact inner-product search over sparse non-negative vectors by a ball tree."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of whole numbers: row i has ``values[starts[i]:starts[i + 1]]`` at ``columns`` of the same places; no row is empty."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = (self.starts[1:] - self.starts[:-1])[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1] - self.starts[rows], sizes)
        return Sparse(starts, self.columns[at], self.values[at])

    def dots(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.columns], self.starts[:-1])

    def dense(self, row: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        out[self.columns[self.starts[row]:self.starts[row + 1]]] = self.values[self.starts[row]:self.starts[row + 1]]
        return out


class BallTree:
    """A binary tree of balls over ``rows``: each node has a centroid and the radius that holds all of its rows.

    A node is split at the median of the difference of distances to two rows far apart. Radii and bounds are in doubles and rounded outward by
    far more than their error, so a bound is never below a score; scores themselves are sums of whole numbers.
    """

    def __init__(self, rows: Sparse, width: int, leaf: int = 64):
        self.width, centroids, radii, self.children, self.spans, leaves = width, [], [], [], [], []
        squares = np.add.reduceat(rows.values.astype(np.float64) ** 2, rows.starts[:-1])
        stack, done = [(np.arange(len(rows)), -1)], 0
        while stack:
            members, parent = stack.pop()
            node, part, norms = len(radii), rows.take(members), squares[members]
            if parent >= 0:
                self.children[parent].append(node)
            c = (np.bincount(part.columns, part.values, width) / len(members)).astype(np.float32)
            apart = self._apart(part, norms, c.astype(np.float64))
            centroids.append(c)
            radii.append(np.sqrt(apart.max()) * (1 + 1e-9))
            self.children.append([])
            self.spans.append(None)
            if len(members) <= leaf:
                self.spans[node] = (done, done + len(members))
                done += len(members)
                leaves.append(members)
                continue
            one = part.dense(int(apart.argmax()), width)
            first = self._apart(part, norms, one)
            other = part.dense(int(first.argmax()), width)
            side = np.argsort(first - self._apart(part, norms, other), kind="stable")
            half = len(members) // 2
            stack += [(members[side[:half]], node), (members[side[half:]], node)]
        self.order = np.concatenate(leaves)
        self.rows = rows.take(self.order)
        self.centroids, self.radii = np.stack(centroids), np.array(radii)

    @staticmethod
    def _apart(part: Sparse, norms: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances, rounded up: cancellation loses less than 1e-9 of the squares it is taken from."""
        own = point @ point
        return np.maximum(norms - 2 * part.dots(point) + own, 0) + 1e-9 * (norms + own)

    def _bounds(self, nodes: list[int], query: np.ndarray) -> np.ndarray:
        inner = self.centroids[np.ix_(nodes, query)].sum(axis=1, dtype=np.float64)
        return (inner + np.sqrt(len(query)) * self.radii[nodes]) * (1 + 1e-9) + 1

    def search(self, query: np.ndarray, least):
        """Rows (numbers, scores) that score at least ``least()`` on ``query``, columns of weight 1; best bounds first.

        ``least`` is asked again before each node, so a caller that raises it as rows come prunes whole subtrees. Rows come leaf by leaf.
        """
        wanted = np.zeros(self.width, np.int64)
        wanted[query] = 1
        queue = [(-self._bounds([0], query)[0], 0)]
        while queue and -queue[0][0] >= least():
            _, node = heapq.heappop(queue)
            if self.spans[node] is None:
                nodes = self.children[node]
                for bound, child in zip(self._bounds(nodes, query), nodes):
                    if bound >= least():
                        heapq.heappush(queue, (-bound, child))
                continue
            lo, hi = self.spans[node]
            a, b = self.rows.starts[lo], self.rows.starts[hi]
            scores = np.add.reduceat(self.rows.values[a:b] * wanted[self.rows.columns[a:b]], self.rows.starts[lo:hi] - a)
            found = np.flatnonzero(scores >= least())
            if len(found):
                yield self.order[lo + found], scores[found]
