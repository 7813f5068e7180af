"""Burrows-Wheeler transforms of shards, and their merge by refining an interleave.

A shard is one circular byte text. Its suffixes are ordered by their first ``depth`` bytes or
more; the transform is the bytes before them. Merging never sorts suffixes of different shards
against each other: the interleave (which shard the next suffix comes from) is refined by a stable
radix pass over the bytes that precede the suffixes, and the borders between suffixes that have
begun to differ are carried along. A pass takes eight bytes as one symbol, their rank among the
eight bytes at all positions, or four or two where there are too many for 16 bits. After ``depth``
bytes the blocks between borders are the classes of suffixes with a common prefix of that length.
"""

from __future__ import annotations

import numpy as np


def grams(shards: list[np.ndarray], width: int) -> tuple[list[np.ndarray], int]:
    """Per shard the rank of the ``width`` (eight at most) bytes from every position on, in the order of such bytes of all shards; the number of ranks."""
    packed = []
    for text in shards:
        wide = np.zeros(len(text), dtype=np.uint64)
        for k in range(width):
            wide = wide << np.uint64(8) | np.roll(text, -k)
        packed.append(wide)
    values, rank = np.unique(np.concatenate(packed), return_inverse=True)
    return np.split(rank.astype(np.uint32), np.cumsum([len(t) for t in shards])[:-1]), len(values)


def suffix_order(rank: np.ndarray, reach: int, depth: int) -> np.ndarray:
    """Positions of a circular text ordered by at least their first ``depth`` bytes (prefix doubling from the ranks of ``reach`` bytes)."""
    n = len(rank)
    order = np.argsort(rank)
    while reach < depth:
        rank = rank.astype(np.uint64)
        packed = rank << np.uint64(32) | np.roll(rank, -reach)
        order = np.argsort(packed)
        first = packed[order]
        rank[order] = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]]))
        reach *= 2
        if int(rank[order[-1]]) == n - 1:
            break
    return order


def preceding(ranks: list[np.ndarray], orders: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Per shard the symbol of the ``width`` bytes before each suffix in order."""
    return [np.roll(r, width)[o].astype(np.uint16) for r, o in zip(ranks, orders)]


def merge(passes: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, class): the shard of each suffix of the merged order, and the number of its class of equal bytes as far as the passes reach.

    A pass holds the 16-bit symbols before the suffixes of each shard. Suffixes of one shard keep their order, so its k-th entry is its k-th suffix.
    """
    shards = len(passes[0])
    z = np.repeat(np.arange(shards, dtype=np.uint8 if shards <= 256 else np.uint32), [len(t) for t in passes[0]])
    block = np.zeros(len(z), dtype=np.int32)
    symbols = np.empty(len(z), dtype=np.uint16)
    for transforms in passes:
        for k, t in enumerate(transforms):
            symbols[z == k] = t
        order = np.argsort(symbols, kind="stable")
        z, was, symbol = z[order], block[order], symbols[order]
        border = np.empty(len(z), dtype=bool)
        border[:1] = False
        np.not_equal(symbol[1:], symbol[:-1], out=border[1:])
        border[1:] |= was[1:] != was[:-1]
        block = np.cumsum(border, dtype=np.int32)
    return z, block


def classes(shards: list[np.ndarray], depth: int, widest: int = 8) -> list[np.ndarray]:
    """Per shard the class of the suffix at every position: equal numbers, in any shards, mean equal first ``depth`` bytes."""
    width = min(widest, depth)
    ranks, several = grams(shards, width)
    orders = [suffix_order(r, width, depth) for r in ranks]
    while several > 1 << 16:
        width = min(4, width - 2)
        ranks, several = grams(shards, width)
    passes = [preceding(ranks, orders, width)] * (depth // width)
    if rest := depth % width:  # fewer bytes have no more ranks
        passes.append(preceding(grams(shards, rest)[0], orders, rest))
    z, block = merge(passes)
    out = []
    for k, order in enumerate(orders):
        c = np.empty(len(order), dtype=np.int32)
        c[order] = block[z == k]
        out.append(c)
    return out
