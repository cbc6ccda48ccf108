"""Suffix arrays of byte shards by induced sorting (Nong, Zhang and Chan, 2009), on numpy.

The two induction scans go bucket by bucket: everything a bucket induces is placed by one stable
counting sort, so a scan is linear in the shard and takes as many steps as there are symbols and
equal-symbol runs. Texts are UTF-8, whose bytes stay below 254: a shard holds byte + 2, with 1
between its pieces and 0 at its end.
"""

from __future__ import annotations

import numpy as np

END, GAP, SHIFT = 0, 1, 2


def shard_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The joined shard and where each piece starts in it."""
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff\xfe", np.uint8) + np.uint8(SHIFT)
    return joined, np.cumsum(sizes) - sizes  # 0xff + 2 and 0xfe + 2 wrap to GAP and END


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where it is larger (L)."""
    ends = np.append(np.flatnonzero(text[:-1] != text[1:]), len(text) - 1)
    rises = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
    return np.repeat(rises, np.diff(ends, prepend=-1))


def _deal(queues: list[list[np.ndarray]], text: np.ndarray, found: np.ndarray) -> None:
    """Append ``found`` to the queues of their first symbols, keeping the order."""
    if not len(found):
        return
    symbols = text[found]
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part in np.split(found, cuts):
        queues[text[part[0]]].append(part)


def _scan(
    text: np.ndarray, wanted: np.ndarray, alphabet: range, fixed: list[np.ndarray]
) -> list[np.ndarray]:
    """One induction scan: from every bucket in turn, its own entries and then ``fixed`` ones,
    place the suffix before each where ``wanted`` allows. Entries come in scan order."""
    queues: list[list[np.ndarray]] = [[] for _ in fixed]
    done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(fixed)
    for symbol in alphabet:
        mine = []
        wave = np.concatenate(queues[symbol]) if queues[symbol] else np.zeros(0, np.int64)
        while len(wave):
            mine.append(wave)
            before = wave[wave > 0] - 1
            before = before[wanted[before]]
            same = text[before] == symbol
            _deal(queues, text, before[~same])
            wave = before[same]
        seeds = fixed[symbol]
        before = seeds[seeds > 0] - 1
        _deal(queues, text, before[wanted[before]])
        if mine:
            done[symbol] = np.concatenate(mine)
    return done


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in theirs."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _deal(seeds, text, lms)
    none = np.zeros(0, np.int64)
    fixed = [np.concatenate(s) if s else none for s in seeds]
    large = _scan(text, ~small, range(size), fixed)
    lows = _scan(text, small, range(size - 1, -1, -1), [x[::-1] for x in large])
    lows[END] = np.array([len(text) - 1])
    return np.concatenate([x for c in range(size) for x in (large[c], lows[c][::-1])])


def order_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of the reduced string. Its alphabet is about as large as itself, so whole
    buckets would hold single entries; ranks of doubled length do the recursion's work."""
    n, step = len(names), 1
    ranks = names.astype(np.int64) + 1
    while True:
        key = ranks * (n + 2)
        key[: n - step] += ranks[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.append(True, key[order][1:] != key[order][:-1]))
        if fresh[order[-1]] == n or step >= n:
            return order
        ranks, step = fresh, step * 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a shard (which ends in END) in order."""
    size = int(text.max()) + 1
    small = smaller_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return induce(text, small, lms, size)
    order = induce(text, small, lms, size)  # by leftmost-smaller substring
    mark = np.zeros(len(text), bool)
    mark[lms] = True
    order = order[mark[order]]
    # equal substrings get one name: same length and same bytes up to the next LMS
    place = np.empty(len(text), np.int64)
    place[lms] = np.arange(len(lms))
    until = np.append(lms[1:], lms[-1])
    left, right = order[:-1], order[1:]
    stop_l, stop_r = until[place[left]], until[place[right]]
    alike = (stop_l - left) == (stop_r - right)
    alike &= common_lengths(text, left, right, stop_l - left + 1, alike) > stop_l - left
    names = np.empty(len(lms), np.int64)
    names[place[order]] = np.cumsum(np.append(False, ~alike))
    if names.max() + 1 == len(lms):
        return induce(text, small, order, size)
    return induce(text, small, lms[order_names(names)], size)


def common_lengths(
    text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, ask: np.ndarray
) -> np.ndarray:
    """Common prefix of text[a:] and text[b:], up to ``most``, where ``ask``; else 0."""
    found = np.zeros(len(a), np.int64)
    padded = np.append(text, np.zeros(8, np.uint8))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    open_ = np.flatnonzero(ask)
    at = 0
    while len(open_):
        x, y = a[open_] + at, b[open_] + at
        inside = np.maximum(x, y) < len(text)
        open_, x, y = open_[inside], x[inside], y[inside]
        differ = eight[x] != eight[y]
        whole = ~differ.any(axis=1)
        found[open_] = at + np.where(whole, 8, differ.argmax(axis=1))
        at += 8
        open_ = open_[whole & (most[open_] > at)]
    return np.minimum(found, most)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position the prefix its suffix shares with the one before it in the order,
    cut at the end of its piece (Kärkkäinen, Manzini and Puglisi, 2009): only positions whose
    left neighbours differ are compared, the others follow from the position before them."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    stops = np.flatnonzero(text <= GAP)
    room = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    has = phi >= 0
    other = np.maximum(phi, 0)
    first = ~has | (other == 0) | (np.arange(n) == 0)
    inner = np.flatnonzero(~first)
    first[inner] = (text[inner - 1] != text[other[inner] - 1]) | (text[inner - 1] <= GAP)
    heads = np.flatnonzero(first)
    lengths = common_lengths(
        text, heads, other[heads], np.minimum(room[heads], n), has[heads] & (room[heads] > 0)
    )
    last = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
    return np.maximum(lengths[last] - (np.arange(n) - heads[last]), 0)
