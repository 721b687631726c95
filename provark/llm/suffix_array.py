"""Suffix arrays by induced sorting, and permuted common prefixes, over byte arrays."""

from __future__ import annotations

import numpy as np


def _spread(sa: np.ndarray, border: np.ndarray, targets: np.ndarray, items: np.ndarray, step: int) -> None:
    """Puts items, in turn, at the borders of their buckets; the borders move by `step` an item."""
    order = np.argsort(targets, kind="stable")
    targets, items = targets[order], items[order]
    at = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
    counts = np.diff(np.append(at, len(targets)))
    within = np.arange(len(targets)) - np.repeat(at, counts)
    own = targets[at]
    if step > 0:
        sa[np.repeat(border[own], counts) + within] = items
        border[own] += counts
    else:
        sa[np.repeat(border[own], counts) - 1 - within] = items
        border[own] -= counts


def _scan(sa: np.ndarray, text: np.ndarray, small: np.ndarray, starts: np.ndarray, border: np.ndarray, up: bool) -> None:
    """One scan of induced sorting over the array, upwards for larger types or downwards for smaller ones.

    It goes by runs of buckets. What a run induces lies at or behind its own buckets; as long as nothing
    falls into the run it is done at once, else only up to the first bucket that receives something. A
    bucket that induces into itself is done alone, in waves."""
    k = len(starts) - 1
    width = max(64, int(2 * np.sqrt(len(text))))
    c = 0 if up else k - 1

    def induced(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = items[items > 0] - 1
        before = before[small[before] != up]
        return before, text[before]

    while 0 <= c < k:
        if up:
            far = min(k, max(c + 1, int(np.searchsorted(starts, starts[c] + width, "right")) - 1))
            items = sa[starts[c] : starts[far]]
        else:
            far = max(-1, min(c - 1, int(np.searchsorted(starts, starts[c + 1] - width, "left")) - 1))
            items = sa[starts[far + 1] : starts[c + 1]][::-1]
        items = items[items >= 0]
        if not len(items):
            c = far
            continue
        before, targets = induced(items)
        if len(targets):
            first = int(targets.min()) if up else int(targets.max())
            if (first < far) if up else (first > far):
                far = first
                items = items[text[items] < far] if up else items[text[items] > far]
                before, targets = induced(items)
        if far != c:
            if len(targets):
                _spread(sa, border, targets, before, 1 if up else -1)
            c = far
            continue
        # waves of one bucket: those that are there, then what they put into it, then the other type's part
        lo, hi = int(starts[c]), int(starts[c + 1])
        done = lo if up else hi
        while done != border[c]:
            edge = int(border[c])
            before, targets = induced(sa[done:edge] if up else sa[edge:done][::-1])
            done = edge
            if len(targets):
                _spread(sa, border, targets, before, 1 if up else -1)
        rest = sa[done:hi] if up else sa[lo:done][::-1]
        before, targets = induced(rest[rest >= 0])
        if len(targets):
            _spread(sa, border, targets, before, 1 if up else -1)
        c += 1 if up else -1


def _scan_each(sa: np.ndarray, text: np.ndarray, small: np.ndarray, border: np.ndarray, up: bool) -> None:
    """The same scan item by item, for texts whose buckets are too small for `_scan` to gain from them."""
    # the bucket that a suffix induces into; none for the first suffix, the other type and (last) an empty place
    bucket = np.full(len(text) + 1, -1, np.int64)
    bucket[1:-1] = np.where(small[:-1] != up, text[:-1], -1)
    bucket, at, out = bucket.tolist(), border.tolist(), sa.tolist()
    if up:
        for j in out:
            c = bucket[j]
            if c >= 0:
                out[at[c]] = j - 1
                at[c] += 1
    else:
        for j in reversed(out):
            c = bucket[j]
            if c >= 0:
                at[c] -= 1
                out[at[c]] = j - 1
    sa[:] = out


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from the order of the leftmost-smaller ones."""
    n = len(text)
    sa = np.full(n, -1, np.int64)
    tails = starts[1:].copy()
    if len(lms):
        _spread(sa, tails, text[lms[::-1]], lms[::-1], -1)
    heads = starts[:-1].copy()
    sa[heads[text[-1]]] = n - 1
    heads[text[-1]] += 1
    wide = n > 1000 * len(heads)
    _scan(sa, text, small, starts, heads, True) if wide else _scan_each(sa, text, small, heads, True)
    placed = sa >= 0
    sa[placed] = np.where(small[sa[placed]], -1, sa[placed])
    tails = starts[1:].copy()
    _scan(sa, text, small, starts, tails, False) if wide else _scan_each(sa, text, small, tails, False)
    return sa


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring, in text order; equal ones share theirs."""
    n, m = len(text), len(lms)
    place = np.empty(n, np.int64)
    place[lms] = np.arange(m)
    stop = np.append(lms[1:], n)
    index = place[ordered]
    length = stop[index] - ordered + 1
    same = np.zeros(m, bool)
    same[1:] = (length[1:] == length[:-1]) & (stop[index[1:]] < n) & (stop[index[:-1]] < n)
    active = np.flatnonzero(same)
    k = 0
    while len(active):
        equal = text[ordered[active] + k] == text[ordered[active - 1] + k]
        same[active[~equal]] = False
        k += 1
        active = active[equal & (length[active] > k)]
    names = np.empty(m, np.int64)
    names[index] = np.cumsum(~same) - 1
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order, by induced sorting; an end is below every symbol.

    text: non-negative numbers, such as bytes. The leftmost-smaller substrings are sorted by inducing from
    any order of theirs, named, and, where names repeat, sorted as suffixes of the string of names."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    # a suffix is smaller than its successor if the first differing symbol after it is larger
    known = np.append(text[:-1] != text[1:], True)
    following = np.minimum.accumulate(np.where(known, np.arange(n), n)[::-1])[::-1]
    small = np.append(text[:-1] < text[1:], False)[following]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(text))])
    first = _induce(text, small, lms, starts)
    if len(lms) < 2:
        return first
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    names = _names(text, lms, ordered)
    if int(names.max()) + 1 < len(lms):
        ordered = lms[suffix_array(names)]
    return _induce(text, small, ordered, starts)


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each start, the common prefix with the suffix before it in the array, in text order.

    Where both suffixes follow the same byte, the value is the one before less one; only the others are
    compared, eight bytes at a time."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = (at > 0) & (before > 0)
    reducible[inner] = text[at[inner] - 1] == text[before[inner] - 1]
    plcp = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, 0, (1,))
    a = at[~reducible & (before >= 0)]
    who, a, b = a, a.copy(), before[a]
    while len(who):
        room = n - np.maximum(a, b)
        other = words[a] ^ words[b]
        low = other & (~other + np.uint64(1))
        bits = np.where(other == 0, 64, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64)
        got = np.minimum(bits // 8, room)
        plcp[who] += got
        on = (got == 8) & (room > 8)
        who, a, b = who[on], a[on] + 8, b[on] + 8
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.where(reducible, plcp[source] - (at - source), plcp)
