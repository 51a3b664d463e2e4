"""A compressed quadtree over the grid of terms and documents, with the largest impact of every cell.

The grid is cut into quadrants again and again; only quadrants that hold a posting are kept. A node
keeps four bits that say which of its quadrants are kept, and each kept quadrant how far its largest
impact lies below the node's, in steps. At the bottom stand the term frequencies. One block of
documents has one such tree, which is built and searched by arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: An impact's steps: bounds are rounded up to a multiple of 2 ** STEP_BITS, so that they fit in a byte.
STEP_BITS = 12
#: Impacts are below this: the quotient of 10 ** 9 * tf and 1000 * tf + 8 * m.
TOP = 10**9
#: Ranges of documents that are cut in two at once.
WIDTH = 128


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth in a document of length measure ``m``, in whole numbers."""
    return TOP * tf // (1000 * tf + 8 * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 31-bit numbers at every second place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """height levels; kept: bits of each inner node's quadrants, level by level; below: steps of each kept quadrant under its node's maximum; tf: of the postings, in quadrant order."""

    height: int
    top: int
    kept: np.ndarray
    below: np.ndarray
    tf: np.ndarray


def build(rows: np.ndarray, columns: np.ndarray, tf: np.ndarray, m: np.ndarray) -> Treap:
    """The tree of distinct postings (row, column) with their term frequencies; ``m`` by column. There is at least one posting."""
    height = max(int(max(rows.max(), columns.max())).bit_length(), 1)
    code = _spread(rows) << np.uint64(1) | _spread(columns)
    order = np.argsort(code)
    code, tf = code[order], tf[order]
    step = (impact(tf.astype(np.int64), m[columns[order]].astype(np.int64)) >> STEP_BITS).astype(np.int16)
    kept, below = [], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        largest = np.maximum.reduceat(step, first)
        kept.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first))
        below.append((np.repeat(largest, np.diff(np.append(first, len(code)))) - step).astype(np.uint8))
        code, step = parent[first], largest
    return Treap(height, int(step[0]), np.concatenate(kept[::-1]), np.concatenate(below[::-1]), tf)


class Searcher:
    """A tree unfolded for search: nodes are numbered from 1 level by level, 0 stands for an empty quadrant."""

    def __init__(self, tree: Treap, m: np.ndarray):
        self.height, self.tf, self.m = tree.height, tree.tf, m.astype(np.int64)
        bits = tree.kept
        sizes = np.bitwise_count(bits).astype(np.int64)
        # a node's quadrants follow one another, from the one after the root on
        self.bits = np.concatenate(([0], bits)).astype(np.uint8)
        self.first = np.concatenate(([0], 2 + np.cumsum(sizes) - sizes))
        self.leaf = 1 + len(bits)  # the number of the first posting
        step = np.zeros(2 + len(tree.below), np.int16)
        step[1] = tree.top
        # maxima level by level: a level's nodes are known when those above are
        at, n = 1, 1
        for _ in range(tree.height):
            below = int(sizes[at - 1 : at - 1 + n].sum())
            step[at + n : at + n + below] = np.repeat(step[at : at + n], sizes[at - 1 : at - 1 + n]) - tree.below[at + n - 2 : at + n - 2 + below]
            at, n = at + n, below
        self.most = (step.astype(np.int64) + 1) << STEP_BITS
        self.most[0] = 0

    def _child(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        bits = self.bits[node]
        there = bits >> quadrant & 1
        before = np.bitwise_count(bits & ((np.uint8(1) << quadrant) - np.uint8(1)))
        return np.where(there == 1, self.first[node] + before, 0)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` columns of the highest weighted impact sums over ``rows``, if of ``least`` or more: columns and sums.

        All rows' paths descend together. Of the ranges of columns not yet cut, those with the
        highest bounds (weighted maxima of their nodes) are cut in two next; a range whose bound is
        below the k-th sum found so far is left out, so no column is missed. Equal sums: the smallest columns.
        """
        found_at, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, level, bound, nodes = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([weights @ np.full(len(rows), self.most[1])]), np.ones((1, len(rows)), np.int64)
        while len(start):
            if len(start) > WIDTH:
                near = np.argpartition(-bound, WIDTH)
                taken, rest = near[:WIDTH], near[WIDTH:]
            else:
                taken, rest = np.arange(len(start)), np.zeros(0, np.int64)
            depth = self.height - 1 - level[taken]
            row_bit = (rows[None, :] >> depth[:, None] & 1).astype(np.uint8) << np.uint8(1)
            halves = [self._child(nodes[taken], row_bit | np.uint8(half)) for half in (0, 1)]
            new = np.concatenate(halves)
            new_start = np.concatenate((start[taken], start[taken] + (1 << depth)))
            new_level = np.tile(level[taken] + 1, 2)
            some = new.any(axis=1)
            new, new_start, new_level = new[some], new_start[some], new_level[some]
            single = new_level == self.height
            if single.any():
                leaves, columns = new[single], new_start[single]
                tf = np.where(leaves > 0, self.tf[np.maximum(leaves - self.leaf, 0)], 0).astype(np.int64)
                sums = impact(tf, self.m[columns][:, None]) @ weights
                found_at, found = np.concatenate((found_at, columns)), np.concatenate((found, sums))
                best = np.lexsort((found_at, -found))[:k]
                best = best[found[best] >= least]
                found_at, found = found_at[best], found[best]
                if len(found) == k:
                    least = max(least, int(found[-1]))
            new, new_start, new_level = new[~single], new_start[~single], new_level[~single]
            start, level, nodes = np.concatenate((start[rest], new_start)), np.concatenate((level[rest], new_level)), np.concatenate((nodes[rest], new))
            bound = np.concatenate((bound[rest], self.most[new] @ weights))
            near = bound >= least
            start, level, bound, nodes = start[near], level[near], bound[near], nodes[near]
        return found_at, found
