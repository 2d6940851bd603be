"""Bit-sliced comparison of fingerprints: bit planes, carry-save counters, abandoned words.

Fingerprints stand as bit planes, 64 rows to a word. Many distances are counted at once: counters are planes too, and a
word is dropped once its rows are all beyond the radius.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def majority(hashes: np.ndarray) -> np.ndarray:
    """rows by words of hashes to one row: bits that more than half of the rows have set."""
    if not len(hashes):
        return np.zeros(hashes.shape[1], np.uint64)
    total = np.zeros(64 * hashes.shape[1], np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[k : k + 4096])
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """rows by 64-bit words to bit planes by words of 64 rows; missing rows are zero."""
    n = -(-len(prints) // 64) * 64
    bits = np.zeros((n, prints.shape[1] * 64), np.uint8)
    bits[: len(prints)] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _add(a, b, c):
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(diff: Callable[[int, np.ndarray], np.ndarray], n_planes: int, radius: int, valid: np.ndarray) -> np.ndarray:
    """Of the rows set in valid, those with at most `radius` of n_planes set in diff.

    diff(k, at): eight planes of differing bits from plane k on, at the words `at`. Counters are bit
    planes themselves, fed by carry-save adders; words whose rows all exceed the radius are dropped.
    """
    out = np.zeros_like(valid)
    at = np.flatnonzero(valid)
    live = valid[at]
    levels = max(4, n_planes.bit_length())
    counts = [np.zeros(len(at), np.uint64) for _ in range(levels)]
    for k in range(0, n_planes, 8):
        if not len(at):
            return out
        p = diff(k, at)
        one, a2 = _add(counts[0], p[0], p[1])
        one, b2 = _add(one, p[2], p[3])
        two, a4 = _add(counts[1], a2, b2)
        one, a2 = _add(one, p[4], p[5])
        one, b2 = _add(one, p[6], p[7])
        two, b4 = _add(two, a2, b2)
        four, carry = _add(counts[2], a4, b4)
        counts[0], counts[1], counts[2] = one, two, four
        for level in range(3, levels):
            counts[level], carry = counts[level] ^ carry, counts[level] & carry
        beyond, equal = np.zeros(len(at), np.uint64), np.full(len(at), ~np.uint64(0))
        for level in range(levels - 1, -1, -1):
            if radius >> level & 1:
                equal = equal & counts[level]
            else:
                beyond |= equal & counts[level]
                equal = equal & ~counts[level]
        live = live & ~beyond
        keep = live != 0
        if keep.sum() < 0.75 * len(at) or not keep.any():
            at, live, counts = at[keep], live[keep], [c[keep] for c in counts]
    out[at] = live
    return out


def set_rows(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def short_links(keys: np.ndarray, prints: np.ndarray, radius: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of equal key, for sorted keys with runs of at most `longest`: all runs at once, shift by shift."""
    n = len(keys)
    planes = planes_of(prints)
    n_words = planes.shape[1]
    padded = np.concatenate([planes, np.zeros((len(planes), 1 + longest // 64 + 1), np.uint64)], axis=1)
    found_a, found_b = [], []
    for s in range(1, longest):
        same = np.zeros(n_words * 64, bool)
        same[: n - s] = keys[s:] == keys[:-s]
        if not same.any():
            break
        valid = np.packbits(same, bitorder="little").view(np.uint64)
        a, b = divmod(s, 64)

        def diff(k: int, at: np.ndarray, a: int = a, b: int = b) -> np.ndarray:
            shifted = padded[k : k + 8, at + a]
            if b:
                shifted = shifted >> np.uint64(b) | padded[k : k + 8, at + a + 1] << np.uint64(64 - b)
            return planes[k : k + 8, at] ^ shifted

        rows = set_rows(within(diff, len(planes), radius, valid))
        found_a.append(rows)
        found_b.append(rows + s)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)



def leader_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows to leaders: the first row without a leader leads all later ones within the radius that have none."""
    planes, n = planes_of(prints), len(prints)
    waiting = mask(np.ones(n, bool))
    found_a, found_b = [], []
    while waiting.any():
        word = int(np.flatnonzero(waiting)[0])
        first = 64 * word + (int(waiting[word]) & -int(waiting[word])).bit_length() - 1
        waiting[word] &= ~(np.uint64(1) << np.uint64(first & 63))
        near = probe(planes, first, radius, waiting)
        waiting &= ~near
        rows = set_rows(near)
        found_a.append(np.full(len(rows), first))
        found_b.append(rows)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def probe(planes: np.ndarray, row: int, radius: int, valid: np.ndarray) -> np.ndarray:
    """Of the rows set in valid, those within the radius of one row, as a mask."""
    own = (planes[:, row >> 6] >> np.uint64(row & 63) & np.uint64(1)).astype(bool)
    flip = np.where(own, ~np.uint64(0), np.uint64(0))[:, None]
    return within(lambda k, at: planes[k : k + 8, at] ^ flip[k : k + 8], len(planes), radius, valid)


def mask(rows: np.ndarray) -> np.ndarray:
    """Booleans as words of 64 rows; missing rows are not set."""
    out = np.zeros(-(-len(rows) // 64) * 8, np.uint8)
    out[: -(-len(rows) // 8)] = np.packbits(rows, bitorder="little")
    return out.view(np.uint64)
