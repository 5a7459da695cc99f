"""Suffix arrays by induced sorting, and permuted longest common prefixes.

The alphabet is small, so a whole bucket is induced at a time: the suffixes that stand before a
bucket's are grouped by their first character in one stable sort. The recursion sorts the names of the
leftmost-smaller substrings; there are many of them, so each is written as two digits, which keeps the alphabet
about as small as the root of their number at every level, down to strings that are short.
"""

from __future__ import annotations

import numpy as np

#: Names below which a string is sorted position by position, which has no cost for each character of an alphabet.
SMALL = 1 << 16


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts behind it; the last one counts as smaller."""
    n = len(text)
    last = np.ones(n, bool)  # of a run of equal characters
    last[:-1] = text[:-1] != text[1:]
    ends = np.flatnonzero(last)
    smaller = np.ones(len(ends), bool)
    smaller[:-1] = text[ends[:-1]] < text[ends[:-1] + 1]
    return np.repeat(smaller, np.diff(np.concatenate([[-1], ends])))


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes, or where the seeds aren't sorted all substrings up to a leftmost-smaller one, in order.

    seeds: the leftmost-smaller positions, those with equal first characters in the order to start from. A bucket
    holds its larger suffixes, which are filled in from the front, and behind them the smaller ones, from the back.
    """
    by = text[seeds]
    order = np.argsort(by, kind="stable")
    seeds = seeds[order]
    cut = np.searchsorted(by[order], np.arange(size + 1)).tolist()
    count = np.bincount(text, minlength=size)
    end = np.cumsum(count)
    begin = end - count
    middle = begin + np.bincount(text[~small], minlength=size)
    out = np.zeros(len(text), np.int32)
    head, tail, steps = begin.copy(), end.copy(), np.arange(len(text))

    def place(cur: np.ndarray, kind: bool) -> None:
        """Put the suffixes before ``cur`` that are of a kind next in their buckets, in the order of ``cur``."""
        before = cur[cur > 0] - 1
        before = before[small[before] == kind]
        n = len(before)
        if not n:
            return
        chars = text[before]
        if n <= 4:
            for i, c in zip(before.tolist(), chars.tolist(), strict=True):
                if kind:
                    tail[c] -= 1
                    out[tail[c]] = i
                else:
                    out[head[c]] = i
                    head[c] += 1
            return
        order = chars.argsort(kind="stable")
        before, chars = before[order], chars[order]
        turn = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        which = chars[np.concatenate([[0], turn])]
        many = np.diff(turn, prepend=0, append=n)
        rank = steps[:n] - np.repeat(np.concatenate([[0], turn]), many)
        if kind:
            out[tail[chars] - 1 - rank] = before
            tail[which] -= many
        else:
            out[head[chars] + rank] = before
            head[which] += many

    starts, ends, middles = begin.tolist(), end.tolist(), middle.tolist()
    for c in range(size):
        at = starts[c]
        while at < (to := int(head[c])):
            batch, at = out[at:to], to
            place(batch, False)
        if cut[c] < cut[c + 1]:
            place(seeds[cut[c] : cut[c + 1]], False)
    out[0], tail[0] = len(text) - 1, 0  # the sentinel, alone in its bucket
    for c in range(size - 1, -1, -1):
        at = ends[c]
        while at > (to := int(tail[c])):
            batch, at = out[to:at][::-1], to
            place(batch, True)
        if starts[c] < middles[c]:
            place(out[starts[c] : middles[c]][::-1], True)
    return out


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """The suffixes of ``text`` in order; its last character is 0 and occurs nowhere else, all are below ``size``."""
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) <= 1:
        return _induce(text, small, lms, size)
    order = _induce(text, small, lms, size)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    names, last = _name(text, lms, order)
    if last + 1 < len(lms):
        order = lms[_sort_names(names, last + 1)]
    return _induce(text, small, order, size)


def _sort_names(names: np.ndarray, size: int) -> np.ndarray:
    """The order of the suffixes of a string of names: each name as two digits, so that the alphabet stays small."""
    if len(names) < SMALL:
        return np.array(_sais(names.tolist(), size))
    base = int(np.ceil(np.sqrt(size)))
    digits = np.zeros(2 * len(names) + 1, np.uint16 if base < 65_000 else np.uint32)
    digits[:-1:2] = names // base + 1
    digits[1:-1:2] = names % base + 1
    order = suffix_array(digits, base + 1)
    return order[(order % 2 == 0) & (order < 2 * len(names))] // 2


def _name(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order, equal for equal substrings, and the largest name."""
    rank = np.empty(len(text), np.int64)
    rank[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, len(text) - 1))[rank[order]]
    a, b = order[:-1], order[1:]
    differ = length[:-1] != length[1:]
    differ[(b == lms[-1]) | (a == lms[-1])] = True
    open_pairs = np.flatnonzero(~differ)
    k = 0
    while len(open_pairs):
        unequal = text[a[open_pairs] + k] != text[b[open_pairs] + k]
        differ[open_pairs[unequal]] = True
        k += 1
        open_pairs = open_pairs[~unequal & (length[:-1][open_pairs] >= k)]
    name = np.concatenate([[0], np.cumsum(differ)])
    out = np.empty(len(lms), np.int64)
    out[rank[order]] = name
    return out, int(name[-1])


def _sais(text: list[int], size: int) -> list[int]:
    """Induced sorting of a list of names whose last is 0 and occurs nowhere else."""
    n = len(text)
    if n == 1:
        return [0]
    small = [True] * n
    for i in range(n - 2, -1, -1):
        a, b = text[i], text[i + 1]
        small[i] = a < b or (a == b and small[i + 1])
    count = [0] * size
    for c in text:
        count[c] += 1
    heads, total = [0] * size, 0
    for c in range(size):
        heads[c] = total
        total += count[c]
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        tail = [h + k for h, k in zip(heads, count, strict=True)]
        for i in reversed(seeds):
            c = text[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = heads[:]
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not small[j]:
                c = text[j]
                sa[head[c]] = j
                head[c] += 1
        tail = [h + k for h, k in zip(heads, count, strict=True)]
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and small[j]:
                c = text[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    if len(lms) > 1:
        place = {i: k for k, i in enumerate(lms)}
        order = [i for i in induce(lms) if i in place]
        ends = lms[1:] + [n - 1]
        names, name, before = [0] * len(lms), -1, None
        for i in order:
            now = text[i : ends[place[i]] + 1]
            if now != before or i == lms[-1]:
                name += 1
            before = now
            names[place[i]] = name
        if name + 1 < len(lms):
            lms = [lms[k] for k in _sais(names, name + 1)]
        else:
            lms = order
    return induce(lms)


def permuted_lcp(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position the common prefix with the suffix before it in the array, and that suffix (-1: none).

    data: the bytes of the text, without the sentinel that ``sa`` begins with. A common prefix is at least the one a
    position earlier less one, and just that where the characters before both suffixes agree; only the others are
    compared, eight bytes at a time.
    """
    n = len(data)
    order = sa[1:]
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    own = before >= 0
    tied = own & (before > 0)
    tied[:1] = False
    tied[1:] &= data[:-1] == data[before[1:] - 1]
    i = np.flatnonzero(own & ~tied)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    live, j = i, before[i].astype(np.int64)
    most = n - np.maximum(i, j)
    done = np.zeros(len(i), np.int64)
    which = np.arange(len(i))
    while len(live):
        x = word[live] ^ word[j]
        same = x == 0
        part = np.full(len(x), 8)
        if not same.all():
            low = x[~same] & (~x[~same] + np.uint64(1))
            part[~same] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        done[which] += part
        same &= done[which] < most[which]
        live, j, which = live[same] + 8, j[same] + 8, which[same]
    reach = np.where(own, 0, at)
    reach[i] = np.minimum(done, most) + i
    return np.where(own, np.maximum(0, np.maximum.accumulate(reach) - at), 0), before
