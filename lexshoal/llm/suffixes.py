"""Suffix order of short strings by two-stage sorting, and what it says of repeats.

Input: segments of one byte buffer. In each segment the first ``starts`` positions begin a suffix,
and ``depth`` bytes follow each of them inside the segment. Suffixes are ordered by their first
``depth`` bytes.

Stage one sorts directly only the suffixes that are smaller than their successors, by eight bytes at
a time. Stage two induces the others, which are larger than their successors, by scanning the
buckets of first bytes in order: when a suffix is met, the suffix one byte before it goes to the next
free place of its own bucket. Segments are extended from their last start to the next position that
is smaller than its successor, or their end, so that every induced suffix has its successor in the
scan. Last, common prefixes of neighbours are measured.
"""

from __future__ import annotations

import numpy as np


def big_words(text: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as a big-endian number (zero bytes after the end)."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    view = np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8")[:, 0].astype(np.uint64)


def smaller_than_successor(text: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position whether its suffix is smaller than the next one; a segment's last position is not.

    first: the first position of each segment; ends: one after its last.
    """
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[ends - 1] = -1
    known = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(known[::-1])[::-1]
    return step[decides] > 0


def sort_directly(text: np.ndarray, words: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the strings there, of at most ``depth`` bytes and not beyond ``end``."""
    order = np.arange(len(at))
    if not len(at):
        return order
    group = np.zeros(len(at), np.int64)
    tied = np.arange(len(at))
    for k in range(0, depth, 8):
        rows = order[tied]
        left = np.clip(np.minimum(end[rows] - at[rows], depth) - k, 0, 8)
        key = words[np.minimum(at[rows] + k, len(text) - 1)]
        cut = (np.uint64(8) * (np.uint64(8) - left.astype(np.uint64))).astype(np.uint64)
        key = np.where(left > 0, (key >> np.minimum(cut, np.uint64(63))) << np.minimum(cut, np.uint64(63)), np.uint64(0))
        if k == 0:
            by = np.argsort(key, kind="stable")
        else:
            by = np.lexsort((key, group[tied]))
        order[tied] = rows[by]
        key, old = key[by], group[tied][by]
        new = np.empty(len(tied), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new[1:] |= old[1:] != old[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(tied)))
        group[tied] = tied[np.repeat(head, size)]
        tied = tied[np.repeat(size > 1, size)]
        if not len(tied):
            break
    return order


def suffix_order(text: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes, in order. Segments lie one after another in ``text``."""
    if not len(first):
        return np.zeros(0, np.int64)
    rising = smaller_than_successor(text, ends, first)
    n = len(text)
    # each segment reaches from its first position to the next rising one after its last start, or its end
    last = first + starts - 1
    next_rising = np.minimum.accumulate(np.where(rising, np.arange(n), n)[::-1])[::-1]
    reach = np.minimum(next_rising[last], ends)
    size = reach - first + 1
    owner = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    position = first[owner] + place  # may be the end of its segment: the empty suffix
    empty = position == ends[owner]
    has_before = place > 0

    words = big_words(text)
    direct = np.flatnonzero(~empty & rising[np.minimum(position, n - 1)])
    direct = direct[sort_directly(text, words, position[direct], ends[owner[direct]], depth)]
    byte_of = text[np.minimum(position, n - 1)].astype(np.int16)
    direct_byte = byte_of[direct]
    by_byte = np.searchsorted(direct_byte, np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done: list[np.ndarray] = []

    def induce(scanned: np.ndarray, least: int) -> None:
        """Send the suffixes before the scanned ones to their buckets, in the order of the scan."""
        before = scanned[has_before[scanned]] - 1
        byte = byte_of[before]
        above = byte > least
        before, byte = before[above], byte[above]
        if len(before):
            by = np.argsort(byte.astype(np.uint8), kind="stable")
            before, byte = before[by], byte[by]
            cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for part in np.split(before, cut):
                waiting[byte_of[part[0]]].append(part)

    induce(np.flatnonzero(empty), -1)
    for c in range(256):
        larger = waiting[c]
        wave = np.concatenate(larger) if larger else np.zeros(0, np.int64)
        waves = []
        while len(wave):
            waves.append(wave)
            wave = wave[has_before[wave]] - 1
            wave = wave[byte_of[wave] == c]
        bucket = [*waves, direct[by_byte[c] : by_byte[c + 1]]]
        bucket = np.concatenate(bucket)
        if len(bucket):
            induce(bucket, c)
            done.append(bucket)
        waiting[c] = []
    order = np.concatenate(done) if done else np.zeros(0, np.int64)
    return position[order[place[order] < starts[owner[order]]]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the length it shares with the one before it, at most ``depth``; 0 for the first."""
    words = big_words(text)
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(0, depth, 8):
        a, b = order[alive - 1] + k, order[alive] + k
        inside = (a < len(text)) & (b < len(text))
        differ = np.where(inside, words[np.minimum(a, len(text) - 1)] ^ words[np.minimum(b, len(text) - 1)], np.uint64(1 << 63))
        same = differ == 0
        if not same.all():
            ends = differ[~same]
            # leading equal bytes of a word
            lead = np.zeros(len(ends), np.int64)
            for j in range(1, 8):
                lead += (ends >> np.uint64(64 - 8 * j)) == 0
            out[alive[~same]] = k + lead
        alive = alive[same]
        out[alive] = k + 8
    return np.minimum(out, depth)
