"""Deep-shallow sorting of strings of one length that start anywhere in a buffer.

Shallow: multikey quicksort over characters of eight bytes; all segments of a
depth are partitioned at once, and a segment of one string is done.  Deep: what
still shares a long prefix is ordered by blind tries.  A node of such a trie
keeps a leaf, and only there whole strings are read: the others are compared
with the leaf, and those that leave it at the same depth by the same byte form a
child.  All nodes of a level are worked on at once, with numpy.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32
WORD = 8


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as big-endian numbers that sort like the bytes; ``data`` must go on for eight bytes more."""
    run = np.lib.stride_tricks.as_strided(data[:WORD].view(np.uint64), (len(data) - WORD + 1,), (1,))
    return run[at].byteswap()


def split(values: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by segment and value, and where in it a new segment or value begins."""
    order = np.lexsort((values, segment))
    v, s = values[order], segment[order]
    return order, np.r_[True, (v[1:] != v[:-1]) | (s[1:] != s[:-1])]


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, start: int, length: int) -> np.ndarray:
    """How many bytes the strings at ``a`` and ``b`` share, at most ``length``; ``start`` of them are known to."""
    shared = np.full(len(a), length, np.int64)
    open_ = np.arange(len(a))
    for depth in range(start, length, WORD):
        x = words_at(data, a[open_] + depth) ^ words_at(data, b[open_] + depth)
        differ = x != 0
        bits = 64 - np.frexp(x[differ].astype(np.float64))[1]
        # rounding of the conversion may carry into the next bit: look at the byte itself
        byte = np.clip(bits // 8, 0, 7)
        late = (x[differ] >> (8 * (7 - byte)).astype(np.uint64)) == 0
        shared[open_[differ]] = np.minimum(depth + byte + late, length)
        open_ = open_[~differ]
        if not len(open_):
            break
    return shared


def deep_shallow(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of ``length`` bytes that start at ``at``, and which of the ordered ones differ from the one before.

    ``data`` goes on for eight bytes after the last string.  Equal strings stay
    in the order they were given in.
    """
    order = np.arange(len(at))
    begins = np.zeros(len(at), bool)  # of the ordered strings: begins a segment
    if len(at):
        begins[0] = True
    live = np.arange(len(at))  # places in ``order`` that belong to segments of two and more
    depth = 0
    while depth < min(SHALLOW, length) and len(live):
        segment = np.cumsum(begins)[live]
        character = words_at(data, at[order[live]] + depth)
        if length - depth < WORD:
            character = character >> np.uint64(8 * (WORD - length + depth))
        by, first = split(character, segment)
        order[live] = order[live][by]
        begins[live] |= first
        live = in_company(begins, live)
        depth += WORD
    depth = min(depth, length)
    while depth < length and len(live):
        segment = np.cumsum(begins[live])
        leaf = order[live][begins[live]][segment - 1]
        own = order[live]
        shared = common_prefix(data, at[own], at[leaf], depth, length)
        edge = np.minimum(shared, length - 1)
        mine, its = data[at[own] + edge].astype(np.int64), data[at[leaf] + edge]
        # below the leaf: the earlier it is left the smaller; above: the later it is left the smaller
        side = np.where(shared == length, 1, np.where(mine < its, 0, 2))
        key = np.where(side == 1, 1 << 40, (side << 40) + (np.where(side == 0, shared, length - shared) << 8) + mine)
        by, first = split(key, segment)
        order[live] = own[by]
        begins[live] |= first
        done = np.zeros(len(order), bool)
        done[live] = (side == 1)[by]
        live = in_company(begins, live)
        live = live[~done[live]]
    return order, begins


def in_company(begins: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Of the places ``live``, those whose segment has another place."""
    after = np.r_[begins[1:], True]
    return live[~(begins[live] & after[live])]
