"""Suffix arrays of byte strings by induced sorting, and permuted longest common prefixes.

All steps work on whole buckets of suffixes as arrays: the induction goes from one first byte to
the next, and within one byte in waves, each of which puts the suffixes one to the left into place.
"""

from __future__ import annotations

import numpy as np


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the end is smallest of all)."""
    n = len(text)
    out = np.zeros(n, bool)
    if n > 1:
        differs = text[:-1] != text[1:]
        at = np.flatnonzero(differs)
        up = np.append(text[at] < text[at + 1], False)  # after the last one there is only the end
        out[:-1] = up[np.cumsum(differs) - differs]
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as little-endian numbers."""
    n = len(text)
    padded = text.tobytes() + bytes(16)
    out = np.empty(n, "<u8")
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(padded, "<u8", len(out[k::8]), k)
    return out


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, pair by pair."""
    n = len(words)
    most = n - np.maximum(a, b)
    out = most.copy()
    open_pairs, at = np.arange(len(a)), 0
    while len(open_pairs):
        x = words[a[open_pairs] + at] ^ words[b[open_pairs] + at]
        stop = x != 0
        bits = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
        ended = open_pairs[stop]
        out[ended] = np.minimum(most[ended], at + (bits[stop].astype(np.int64) // 8))
        at += 8
        open_pairs = open_pairs[~stop]
        open_pairs = open_pairs[most[open_pairs] > at]
    return out


def _put(found: np.ndarray, text: np.ndarray, array: np.ndarray, ends: np.ndarray, step: int) -> None:
    """Appends suffixes to their buckets in order: upwards from ``ends`` or downwards before it."""
    first = text[found]
    order = np.argsort(first, kind="stable")
    found, first = found[order], first[order]
    counts = np.bincount(first, minlength=len(ends))
    within = np.arange(len(found)) - (np.cumsum(counts) - counts)[first]
    array[ends[first] + within if step > 0 else ends[first] - 1 - within] = found
    ends += step * counts


def induce(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order (or, for their substrings
    only, in any order)."""
    n = len(text)
    array = np.empty(n, np.int32)
    sizes = np.bincount(text, minlength=256)
    tops = np.cumsum(sizes)
    bottoms = tops - sizes
    used = np.flatnonzero(sizes).tolist()
    by_byte = leftmost[np.argsort(text[leftmost], kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(text[leftmost], minlength=256))])

    def left_of(wave: np.ndarray, kind: bool) -> np.ndarray:
        before = wave[wave > 0] - 1
        return before[smaller[before] == kind]

    heads = bottoms.copy()
    _put(np.array([n - 1], np.int32), text, array, heads, 1)
    for c in used:
        done = bottoms[c]
        while done < heads[c]:
            wave = array[done : heads[c]]
            done = heads[c]
            _put(left_of(wave, False), text, array, heads, 1)
        if cuts[c] < cuts[c + 1]:
            _put(left_of(by_byte[cuts[c] : cuts[c + 1]], False), text, array, heads, 1)
    tails = tops.copy()
    for c in reversed(used):
        done = tops[c]
        while done > tails[c]:
            wave = array[tails[c] : done][::-1]
            done = tails[c]
            _put(left_of(wave, True), text, array, tails, -1)
        if heads[c] > bottoms[c]:
            _put(left_of(array[bottoms[c] : heads[c]][::-1], True), text, array, tails, -1)
    return array


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of the string of names in order. Its alphabet is as large as itself, so there
    are no buckets worth a wave: the order of prefixes is doubled until all differ."""
    m = len(names)
    array = np.argsort(names, kind="stable")
    ordered = names[array]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(m + 1, np.int64)
    rank[m] = -1
    rank[array] = np.maximum.accumulate(np.where(starts, np.arange(m), 0))
    step = 1
    alone = starts & np.append(starts[1:], True)
    open_at = np.flatnonzero(~alone)
    while len(open_at):
        members = array[open_at]
        group = rank[members]
        key = group * (m + 1) + rank[np.minimum(members + step, m)] + 1
        order = np.argsort(key, kind="stable")
        members, key = members[order], key[order]
        array[open_at] = members
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        rank[members] = open_at[np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))]
        alone = starts & np.append(starts[1:], True)
        open_at = open_at[~alone]
        step *= 2
    return array


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The positions of a byte string in the order of their suffixes."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int32)
    smaller = smaller_types(text)
    leftmost = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(leftmost) > 1:
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        array = induce(text, smaller, leftmost)
        ordered = array[is_leftmost[array]]
        lengths = np.zeros(n, np.int64)
        # From one leftmost-smaller position to the next, both included; the last one has the end, too.
        lengths[leftmost] = np.append(leftmost[1:], n) - leftmost + 1
        a, b = ordered[:-1], ordered[1:]
        alike = np.flatnonzero(lengths[a] == lengths[b])
        same = np.zeros(len(a), bool)
        same[alike] = common_prefixes(_words(text), a[alike], b[alike]) >= lengths[a[alike]]
        names_at = np.zeros(n, np.int64)
        names_at[ordered] = np.concatenate([[0], np.cumsum(~same)])
        if same.any():
            leftmost = leftmost[_order_of_names(names_at[leftmost])]
        else:
            leftmost = ordered
    return induce(text, smaller, leftmost)


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """By position: the common prefix with the suffix just before it in the order.

    Where the bytes to the left of both are equal, the value is that of the position to the left
    less one; only the other (irreducible) positions are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    compared = np.ones(n, bool)
    later = np.flatnonzero(before[1:] > 0) + 1
    compared[later] = text[later - 1] != text[before[later] - 1]
    at = np.flatnonzero(compared & (before >= 0))
    reach = np.zeros(n, np.int64)
    reach[at] = at + common_prefixes(_words(text), at, before[at])
    first = array[:1]
    reach[first] = first
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)
