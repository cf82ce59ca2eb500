"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, shard merging.

A shard's text is a row of segments. Each is taken to end in a terminator of its own, below any
byte, so no two suffixes are equal and no common prefix reaches over a segment's end.
"""

from __future__ import annotations

import numpy as np

BITS, LARGEST = np.uint64(21), 1 << 21  # bits of a place, symbols of a shard at most
FIRST = 4  # symbols of nine bits that fit a 64-bit number beside a place


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, rank)`` of all suffixes of ``text`` (uint8, up to 2**21 symbols); ``ends`` are the
    segments' ends.

    Suffixes are first sorted by four symbols, then groups that are still equal at depth h are
    refined by the rank of what follows h symbols later; sorted groups are left alone. What is
    sorted by and the place it belongs to share one 64-bit number.
    """
    n = len(text)
    if n > LARGEST:
        raise ValueError(f"a shard has more than {LARGEST} symbols")
    size = np.diff(ends, prepend=0)
    segment = np.repeat(np.arange(len(ends), dtype=np.uint64), size)
    left = np.repeat(ends, size) - np.arange(n)  # symbols before the terminator
    symbols = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(FIRST, np.uint64)])
    key, place, low = np.zeros(n, np.uint64), np.arange(n, dtype=np.uint64), np.uint64(LARGEST - 1)
    for j in range(FIRST):
        key = key << np.uint64(9) | symbols[j : n + j] * (left > j)
    sort = np.sort(key << BITS | place)
    order, key = (sort & low).astype(np.int64), sort >> BITS
    heads = np.append(True, key[1:] != key[:-1])[:n]
    rank = np.empty(n, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    at = np.flatnonzero(~(heads & np.append(heads[1:], True)))  # places whose suffixes are not yet told apart
    depth = FIRST
    while len(at):
        who = order[at]
        # Past the text comes the terminator itself, by segments and below any rank.
        after = np.where(left[who] > depth, rank[np.minimum(who + depth, n - 1)] + np.uint64(len(ends)), segment[who])
        # Groups are consecutive in ``at``, so sorting by group and what follows keeps them in place.
        group = np.cumsum(np.append(True, rank[who[1:]] != rank[who[:-1]])).astype(np.uint64) - np.uint64(1)
        sort = np.sort((group << (BITS + np.uint64(1)) | after) << BITS | np.arange(len(at), dtype=np.uint64))
        who, key = who[(sort & low).astype(np.int64)], sort >> BITS
        order[at] = who
        fresh = np.append(True, key[1:] != key[:-1])
        rank[who] = np.maximum.accumulate(np.where(fresh, at, 0))
        at = at[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order, rank


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``lcp[j]``: symbols that suffixes ``order[j - 1]`` and ``order[j]`` share; 0 for the first.

    Kasai's lemma in text order: a suffix shares at least one symbol less with the one before it
    in the order than its predecessor in the text does, and exactly one less where the symbols
    before both are equal. Only the other suffixes are compared, all at once.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    segment = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    starts = np.concatenate([[0], ends[:-1]])
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    follows = (before >= 0) & (i > starts[segment])
    follows &= (before > starts[segment[before]]) & (text[i - 1] == text[before - 1])
    shared = np.zeros(n, np.int64)
    open_ = np.flatnonzero(~follows & (before >= 0))
    # Eight symbols at a time: how many low bytes of two numbers are equal.
    words = np.ndarray((n,), "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    room = np.minimum(ends[segment[open_]] - open_, ends[segment[before[open_]]] - before[open_])
    while len(open_):
        done = shared[open_]
        differ = words[np.minimum(open_ + done, n - 1)] ^ words[np.minimum(before[open_] + done, n - 1)]
        equal = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        equal = np.minimum(equal, room - done)
        shared[open_] += equal
        more = equal == 8
        open_, room = open_[more], room[more]
    known = np.maximum.accumulate(np.where(follows, 0, i))
    shared = shared[known] - (i - known)
    return np.maximum(shared, 0)[order]


def shared_starts(text: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of places where equal strings of ``length`` bytes start, in order of the strings:
    all such places, the group of each, and each group's least ``owner`` (one for each segment)."""
    order, _ = suffix_array(text, ends)
    lcp = common_prefixes(text, ends, order)
    segment = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = ends[segment[order]] - order >= length
    order, new = order[whole], lcp[whole] < length
    # A shorter suffix between two long ones would lower their common prefix, so none is lost.
    if not len(order):
        return order, order, owner[:0]
    new[0] = True
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[segment[order]], heads)
    return order, np.cumsum(new) - 1, least


def strings_at(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings of ``length`` bytes at ``at``, as fixed-width bytes that sort as bytes do."""
    return np.ascontiguousarray(text[at[:, None] + np.arange(length)]).view(f"S{length}").ravel()


def merge(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted table of strings and their least owners with another shard's merged in, whose
    places among the table's strings are found by binary search."""
    known, owners = table
    if not len(known):
        return keys, least
    at = np.searchsorted(known, keys)
    there = known[np.minimum(at, len(known) - 1)] == keys
    owners = owners.copy()
    owners[at[there]] = np.minimum(owners[at[there]], least[there])
    return np.insert(known, at[~there], keys[~there]), np.insert(owners, at[~there], least[~there])


def least_owners(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For shards (text, ends, owner): the places where strings of ``length`` start, and the
    least owner of each place's string over all shards."""
    found = [shared_starts(*shard, length) for shard in shards]
    if len(shards) == 1:
        return [(order, least[group]) for order, group, least in found]
    # Only the distinct strings of each shard are merged.
    table: tuple[np.ndarray, np.ndarray] = (np.zeros(0, f"S{length}"), np.zeros(0, np.int64))
    keys = []
    for (text, _, _), (order, group, least) in zip(shards, found, strict=True):
        heads = order[np.flatnonzero(np.diff(group, prepend=-1))]
        keys.append(strings_at(text, heads, length))
        table = merge(table, keys[-1], least)
    return [(order, table[1][np.searchsorted(table[0], k)][group]) for (order, group, _), k in zip(found, keys, strict=True)]
