"""Karmarkar-Karp multiway number partitioning on one bounded batch of sizes."""

from __future__ import annotations

import heapq
import math

import numpy as np


def partition(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of every size, and the load of every window, for ``windows`` near-equal windows.

    A partial partition is a vector of loads, ascending, with the root of a tree of sizes for
    each. The two most uneven ones are merged, the largest load of the one onto the smallest of
    the other, until one is left.
    """
    n = len(sizes)
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)
    nodes = n
    heap = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, np.array([s], np.int64), np.array([i], np.int64)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tag, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        # Only the loaded ends of the vectors are stored; what is missing are empty windows.
        width = min(windows, len(a) + len(b))
        loads, roots = np.zeros(width, np.int64), np.full(width, -1, np.int64)
        loads[width - len(a) :] = a
        roots[width - len(a) :] = ra
        loads[: len(b)] += b[::-1]
        other = rb[::-1]
        mine = roots[: len(b)]
        both = mine >= 0
        k = int(both.sum())
        if k:
            ids = np.arange(nodes, nodes + k)
            left[ids], right[ids] = mine[both], other[both]
            nodes += k
            joined = other.copy()
            joined[both] = ids
            roots[: len(b)] = joined
        else:
            roots[: len(b)] = other
        order = np.argsort(loads, kind="stable")
        loads, roots = loads[order], roots[order]
        low = int(loads[0]) if width == windows else 0
        heapq.heappush(heap, (low - int(loads[-1]), tag, loads, roots))
    if not heap:
        return np.zeros(0, np.int64), np.zeros(windows, np.int64)
    _, _, loads, roots = heap[0]
    owner = np.full(2 * n, -1, np.int64)
    for w, r in enumerate(roots.tolist()):
        if r >= 0:
            owner[r] = w
    for node in range(nodes - 1, n - 1, -1):  # parents come after their children
        owner[left[node]] = owner[right[node]] = owner[node]
    return owner[:n], loads


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """As few near-equal windows as the differencing finds that hold at most ``capacity`` each.

    The count begins at the least possible and rises whenever a window is too full, by as much
    as the excess asks for.
    """
    total = int(sizes.sum())
    windows = max(1, math.ceil(total / capacity))
    while True:
        owner, loads = partition(sizes, windows)
        over = int(loads.max(initial=0)) - capacity
        if over <= 0:
            return owner, loads
        windows += max(1, math.ceil(windows * over / capacity / 4))
