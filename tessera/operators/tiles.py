"""What can be decided within a tile of an image: small functions over the nodes of one tile, which joins put together.

A tile is a square of TILE pixels a side, so that a group is bounded whatever the
size of its image; what leaves a tile is left to rounds of joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 128
#: Bits of a node's name below its line.
LINE_BITS = 31


def tile_of(node: Column, side: int = TILE) -> Column:
    """The tile of a node that is named by a pixel or lattice corner: line * 2 ** LINE_BITS + column."""
    y, x = F.shiftright(node.cast("long"), LINE_BITS), node.cast("long").bitwiseAND((1 << LINE_BITS) - 1)
    return F.floor(y / side).cast("long") * (1 << LINE_BITS) + F.floor(x / side).cast("long")


def places_of(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted name stands among distinct names, -1 for none."""
    order = np.argsort(names)
    at = np.minimum(np.searchsorted(names[order], wanted), len(names) - 1)
    return np.where(names[order][at] == wanted, order[at], -1)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over edges a - b: hook to the smaller label, then jump."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def chain_places(names: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, place, size, ring, last) of each node over ``ahead``, where -1 is an end; a ring is cut before its smallest name."""
    ahead, ring = ahead.copy(), np.zeros(len(ahead), bool)
    for _ in range(2):
        go, far, last, least = ahead.copy(), (ahead >= 0).astype(np.int64), np.arange(len(ahead)), names.copy()
        for _ in range(max(1, int(len(ahead)).bit_length()) + 1):
            at = np.flatnonzero(go >= 0)
            if not len(at):
                break
            to = go[at]
            least[at] = np.minimum(least[at], least[to])
            far[at], last[at], go[at] = far[at] + far[to], last[to], go[to]
        turns = go >= 0
        if not turns.any():
            break
        ring |= turns
        ahead[turns & (names[ahead] == least)] = -1
    size = np.zeros(len(ahead), np.int64)
    np.maximum.at(size, last, far + 1)
    place = size[last] - 1 - far
    head = np.zeros(len(ahead), np.int64)
    head[last[place == 0]] = names[place == 0]
    return head[last], place, size[last], ring, last


def forest(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which edges a - b of n nodes are in the minimum spanning forest by distinct ranks 0, 1, ...: Borůvka's rounds."""
    taken, label = np.zeros(len(a), bool), np.arange(n)
    by_rank = np.argsort(rank)
    left = np.arange(len(a))
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return taken
        least = np.full(n, len(a))
        for end in (a, b):
            np.minimum.at(least, label[end[left]], rank[left])
        chosen = by_rank[np.unique(least[least < len(a)])]
        taken[chosen] = True
        label = least_labels(n, np.r_[a[chosen], label[a[chosen]], np.arange(n)], np.r_[b[chosen], a[chosen], label])
