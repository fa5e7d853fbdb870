"""Suffix arrays of many short strings at once, by induced sorting in lockstep, and their permuted common prefixes.

A lane is one string of symbols that ends with 0, which stands nowhere else in it.  All lanes of a call have the same steps: at scan position p every lane
looks at its own p-th suffix and induces that suffix's left neighbour, so one numpy operation serves a step of all lanes and the work is
linear in the length of the longest.  Arrays are position-major: the entry of lane m at position p is at p * lanes + m.
"""

from __future__ import annotations

import numpy as np


def _induce(sa: np.ndarray, to: np.ndarray, edge: np.ndarray, lanes: int, slots: int, step: int) -> None:
    """One scan over the suffix array: forward for L-type (step lanes), backward for S-type suffixes (step -lanes).

    ``to`` is the bucket of each suffix's left neighbour if that is of the wanted type, else the last bucket, whose slot is never read; ``edge`` is the
    next free slot of each bucket."""
    spare = edge[-lanes:].copy()
    order = range(slots) if step > 0 else range(slots - 1, -1, -1)
    rest = edge[-lanes:]
    for p in order:
        here = sa[p * lanes:(p + 1) * lanes]
        bucket = to.take(here)
        slot = edge.take(bucket)
        sa[slot] = here - lanes
        edge[bucket] = slot + step
        rest[:] = spare


def _placed(lms: np.ndarray, symbol: np.ndarray, ends: np.ndarray, lanes: int) -> np.ndarray:
    """Slots at the ends of their buckets for suffixes ordered by lane and symbol."""
    key = symbol[lms] * lanes + lms % lanes
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    many = np.diff(np.append(begin, len(key)))
    behind = np.repeat(begin + many, many) - np.arange(len(key))  # how many of the bucket from here on
    return ends[key] - behind * lanes


def suffix_arrays(symbol: np.ndarray, sizes: np.ndarray, alphabet: int) -> np.ndarray:
    """(longest, lanes): start of the lane's p-th suffix; behind a lane's size the rows mean nothing.

    ``symbol``: (longest, lanes), anything behind a lane's 0."""
    longest, lanes = symbol.shape
    inside = np.arange(longest)[:, None] < sizes[None, :]
    symbol = np.where(inside, symbol, 1).astype(np.int64)
    # classify: S if smaller than the suffix to the right
    small = np.zeros((longest + 1, lanes), bool)
    small[longest - 1] = symbol[longest - 1] == 0
    for p in range(longest - 2, -1, -1):
        small[p] = (symbol[p] < symbol[p + 1]) | (symbol[p] == symbol[p + 1]) & small[p + 1]
    small[:longest] &= inside
    leftmost = np.zeros((longest + 1, lanes), bool)
    leftmost[1:longest] = small[1:longest] & ~small[:longest - 1]
    lane = np.arange(lanes)
    flat = symbol.ravel()
    bucket = (symbol * lanes + lane).ravel()
    counts = np.bincount(bucket[inside.ravel()], minlength=alphabet * lanes).reshape(alphabet, lanes)
    ends = (np.cumsum(counts, 0) * lanes + lane)
    starts = (ends - counts * lanes)
    spare = (longest * lanes + lane)[None, :]  # the slot that is never read
    trash = alphabet * lanes + lane
    to_large = np.empty((longest + 1, lanes), np.int64)
    to_small = np.empty((longest + 1, lanes), np.int64)
    to_large[0] = to_small[0] = to_large[longest] = to_small[longest] = trash
    shifted, bucket = small[:longest - 1], bucket.reshape(longest, lanes)
    to_large[1:longest] = np.where(shifted | ~inside[1:], trash, bucket[:-1])
    to_small[1:longest] = np.where(shifted & inside[1:], bucket[:-1], trash)
    to_large, to_small = to_large.ravel(), to_small.ravel()
    empty = np.broadcast_to(longest * lanes + lane, (longest + 1, lanes)).ravel()

    def induced(lms: np.ndarray) -> np.ndarray:
        sa = empty.copy()
        sa[_placed(lms, flat, ends.ravel(), lanes)] = lms
        _induce(sa, to_large, np.concatenate([starts, spare]).ravel(), lanes, longest, lanes)
        _induce(sa, to_small, np.concatenate([ends - lanes, spare]).ravel(), lanes, longest, -lanes)
        return sa[:longest * lanes]

    of_lane, at = np.nonzero(leftmost[:longest].T)  # by lane, then in order of the text
    text_order = at * lanes + of_lane
    per_lane = np.bincount(of_lane, minlength=lanes)
    begin = np.cumsum(per_lane) - per_lane
    # sort leftmost-smaller substrings
    first_order = text_order[np.lexsort((text_order, flat[text_order], of_lane))]
    sa = induced(first_order).reshape(longest, lanes).T.ravel()
    is_leftmost = leftmost.ravel()
    ordered = sa[is_leftmost[sa]]
    # name them: equal neighbours share a name
    length = np.zeros((longest + 1) * lanes, np.int64)
    length[text_order[:-1]] = np.where(of_lane[1:] == of_lane[:-1], at[1:] - at[:-1], 0)
    new = np.ones(len(ordered), bool)
    a, b = ordered[:-1], ordered[1:]
    pair = np.flatnonzero((a % lanes == b % lanes) & (length[a] == length[b]) & (length[a] > 0))
    a, b, left = a[pair], b[pair], length[ordered[pair]]
    while len(pair):
        same = flat[a] == flat[b]
        done = same & (left == 0)
        new[pair[done] + 1] = False
        go = same & ~done
        pair, a, b, left = pair[go], a[go] + lanes, b[go] + lanes, left[go] - 1
    name = np.cumsum(new) - 1
    name -= np.repeat(name[begin], per_lane)
    names = np.zeros((longest + 1) * lanes, np.int64)
    names[ordered] = name
    different = np.bincount(of_lane, weights=new, minlength=lanes).astype(np.int64)
    again = np.flatnonzero(different < per_lane)
    rank = np.arange(len(text_order)) - np.repeat(begin, per_lane)
    if len(again):  # sort the shorter strings of names of the lanes where names repeat
        reduced = np.zeros((int(per_lane[again].max()), len(again)), np.int64)
        place = np.full(lanes, -1, np.int64)
        place[again] = np.arange(len(again))
        take = place[of_lane] >= 0
        reduced[rank[take], place[of_lane[take]]] = names[text_order[take]]
        deeper = suffix_arrays(reduced, per_lane[again], int(different[again].max()))
        sorted_rank = np.concatenate([deeper[:n, i] for i, n in enumerate(per_lane[again].tolist())])
        where = np.flatnonzero(take)  # in lane order, as the places of sorted suffixes are
        ordered[where] = text_order[np.repeat(begin[again], per_lane[again]) + sorted_rank]
    return (induced(ordered) // lanes).reshape(longest, lanes)


def common_prefixes(symbol: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lanes laid end to end: the permuted common prefixes (how many symbols each suffix shares with its predecessor in order) and those predecessors.

    Only irreducible values (the symbols in front differ) are compared symbol by symbol; any other is its left neighbour's less one.
    ``symbol``: uint16, ``sa``: places in the whole, lane by lane in order."""
    n = len(symbol)
    before = np.full(n, -1, np.int64)
    first = np.zeros(n, bool)
    first[starts] = True
    inner = ~first
    before[sa[inner]] = sa[np.flatnonzero(inner) - 1]
    has = before >= 0
    irreducible = np.ones(n, bool)
    both = np.flatnonzero(has & ~first & (before > 0) & ~first[np.maximum(before, 0)])
    irreducible[both] = symbol[both - 1] != symbol[before[both] - 1]
    irreducible[~has] = True
    padded = np.concatenate([symbol, np.zeros(4, symbol.dtype)]).astype(np.uint64)
    four = padded[:n] | padded[1:n + 1] << np.uint64(16) | padded[2:n + 2] << np.uint64(32) | padded[3:n + 3] << np.uint64(48)
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(irreducible & has)
    a, b = live.copy(), before[live]
    while len(live):
        x = four[a] ^ four[b]
        low = x & (~x + np.uint64(1))
        equal = np.where(low >= np.uint64(1 << 48), 3, np.where(low >= np.uint64(1 << 32), 2, np.where(low >= np.uint64(1 << 16), 1, 0)))
        whole = x == 0
        shared[live] += np.where(whole, 4, equal)
        live, a, b = live[whole], a[whole] + 4, b[whole] + 4
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.where(has, shared[last] - (at - last), 0), before


__all__ = ["common_prefixes", "suffix_arrays"]
