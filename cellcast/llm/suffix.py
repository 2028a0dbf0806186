"""Suffix arrays and common prefixes of integer strings."""

from __future__ import annotations

import numpy as np

#: Symbols a bucket must hold on average for numpy to beat a plain loop over suffixes.
_DENSE = 64


def suffix_types(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next (S); the empty suffix after it is S."""
    n = len(text)
    small = np.zeros(n + 1, bool)
    small[n] = True
    if n > 1:
        rises = np.sign(text[1:].astype(np.int64) - text[:-1])
        # an equal neighbour has the type of the next unequal pair; the last suffix is L
        place = np.where(rises != 0, np.arange(n - 1), n - 1)
        nearest = np.minimum.accumulate(place[::-1])[::-1]
        small[: n - 1] = np.append(rises, -1)[nearest] > 0
    return small


def _induce_by_bucket(text: np.ndarray, small: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sorts all suffixes from leftmost-smaller ones in ``order``, a bucket at a time.

    The predecessors of a bucket's suffixes are dealt to their buckets together; those that
    stay in the same bucket make its next round.
    """
    n, sigma = len(text), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    heads, tails = starts[:-1].copy(), starts[1:].copy()
    chars = text[order]
    seeds = order[np.argsort(chars, kind="stable")]
    seed_stops = np.cumsum(np.bincount(chars, minlength=sigma))
    large_stop = starts[:-1] + np.bincount(text[~small[:n]], minlength=sigma)

    def deal(before: np.ndarray, ends: np.ndarray, step: int) -> None:
        if not len(before):
            return
        at = text[before]
        by = np.argsort(at, kind="stable")
        at = at[by]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        sizes = np.diff(first, append=len(at))
        rank = np.arange(len(at)) - np.repeat(first, sizes)
        sa[(ends[at] + rank) if step > 0 else (ends[at] - 1 - rank)] = before[by]
        ends[at[first]] += step * sizes

    # larger suffixes, left to right; the empty suffix comes before all
    if not small[n - 1]:
        deal(np.array([n - 1]), heads, 1)
    for c in np.flatnonzero(np.diff(starts)):
        done = starts[c]
        while done < heads[c]:
            stop = heads[c]
            before = sa[done:stop] - 1
            before = before[before >= 0]
            deal(before[~small[before]], heads, 1)
            done = stop
        own = seeds[seed_stops[c - 1] if c else 0 : seed_stops[c]] - 1
        own = own[own >= 0]
        deal(own[~small[own]], heads, 1)
    # smaller suffixes, right to left
    for c in np.flatnonzero(np.diff(starts))[::-1]:
        done = starts[c + 1]
        while done > tails[c]:
            stop = tails[c]
            before = sa[stop:done][::-1] - 1
            before = before[before >= 0]
            deal(before[small[before]], tails, -1)
            done = stop
        before = sa[starts[c] : large_stop[c]][::-1] - 1
        before = before[before >= 0]
        deal(before[small[before]], tails, -1)
    return sa


def _induce_by_suffix(text: np.ndarray, small: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The same, a suffix at a time, for alphabets so large that buckets hold a few suffixes."""
    n = len(text)
    t = text.tolist()
    sa = [-1] * n
    tails = starts[1:].tolist()
    for i in reversed(order.tolist()):
        tails[t[i]] -= 1
        sa[tails[t[i]]] = i
    # the symbol before each suffix, or -1 where that one isn't to be induced; last, for empty places
    is_small = small[: n - 1]
    larger = [-1, *np.where(is_small, -1, text[:-1]).tolist(), -1]
    smaller = [-1, *np.where(is_small, text[:-1], -1).tolist()]
    heads = starts[:-1].tolist()
    if not small[n - 1]:
        sa[heads[t[n - 1]]] = n - 1
        heads[t[n - 1]] += 1
    for i in sa:  # which grows ahead of this loop
        c = larger[i]
        if c >= 0:
            sa[heads[c]] = i - 1
            heads[c] += 1
    tails = starts[1:].tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            tails[c] -= 1
            sa[tails[c]] = i - 1
    return np.array(sa, np.int64)


def _names(text: np.ndarray, marks: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Ranks of leftmost-smaller substrings, equal ones alike, in the order of ``ranked``.

    ``marks`` are the starts in text order; a substring ends with the next one's first symbol,
    the last with the text.
    """
    n = len(text)
    ends = np.append(marks[1:], n)
    spot = np.full(n, -1, np.int64)
    spot[marks] = np.arange(len(marks))
    a, b = ranked[:-1], ranked[1:]
    long_a, long_b = ends[spot[a]] - a, ends[spot[b]] - b
    differs = long_a != long_b
    # the last substring ends with the empty suffix, which no other has
    differs |= (a == marks[-1]) | (b == marks[-1])
    open_ = np.flatnonzero(~differs)
    k = 0
    while len(open_):
        unequal = text[a[open_] + k] != text[b[open_] + k]
        differs[open_[unequal]] = True
        open_ = open_[~unequal & (k < long_a[open_])]
        k += 1
    names = np.empty(len(marks), np.int64)
    names[spot[ranked]] = np.append(0, np.cumsum(differs))
    return names


def induced_suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text``, integers from 0 on, in ascending order; linear in its length.

    Suffixes are classified; the leftmost-smaller ones are sorted by inducing them from any
    order of their own, named by their substrings, and, if names repeat, by the suffix array
    of the string of names; all others are induced from them. The end counts as the least symbol.
    """
    text = np.asarray(text, np.int64)
    n = len(text)
    if n < 2:
        return np.arange(n)
    sigma = int(text.max()) + 1
    small = suffix_types(text)
    starts = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))
    induce = _induce_by_bucket if n >= _DENSE * np.count_nonzero(np.diff(starts)) else _induce_by_suffix
    marks = np.flatnonzero(small[1:n] & ~small[: n - 1]) + 1
    if not len(marks):
        return induce(text, small, starts, marks)
    rough = induce(text, small, starts, marks)
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    ranked = rough[is_mark[rough]]
    names = _names(text, marks, ranked)
    if names.max() + 1 < len(marks):
        ranked = marks[induced_suffix_array(names)]
    return induce(text, small, starts, ranked)


def doubled_suffix_array(text: np.ndarray) -> np.ndarray:
    """The same order, by ranks of prefixes whose length doubles; only tied suffixes go on."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.append(True, text[order[1:]] != text[order[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    k = 1
    while len(tied):
        own = order[tied]
        group, after = first[tied], rank[np.minimum(own + k, n)]
        by = np.lexsort((after, group))
        own, after = own[by], after[by]  # groups stay where they are
        order[tied] = own
        fresh = np.append(True, (after[1:] != after[:-1]) | (group[1:] != group[:-1]))
        head = np.maximum.accumulate(np.where(fresh, tied, 0))
        first[tied] = head
        rank[own] = head
        alone = fresh & np.append(fresh[1:], True)
        tied = tied[~alone]
        k *= 2
    return order


def sparse_suffix_array(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of some suffixes, given by their first bytes, and the common prefix of each with the one before it.

    Prefixes are in the order found, that of the first is 0.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    own = [suffixes[i] for i in order]
    sizes = np.array([len(s) for s in own], np.int64)
    width = int(sizes.max(initial=0))
    table = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in own]), np.uint8).reshape(len(own), width)
    differs = np.ones((max(0, len(own) - 1), width + 1), bool)
    np.not_equal(table[1:], table[:-1], out=differs[:, :width])
    # a filled place may equal a byte, so no prefix is longer than the shorter suffix
    shared = np.minimum(differs.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    return np.array(order, np.int64), np.append(0, shared)[: len(own)]


def _prefix_lengths(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the suffixes at ``a`` and ``b``."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    active = np.flatnonzero(np.maximum(a, b) < n)
    k = 0
    while len(active) > 256:
        same = text[a[active] + k] == text[b[active] + k]
        out[active[same]] += 1
        k += 1
        active = active[same]
        active = active[np.maximum(a[active], b[active]) + k < n]
    for i in active.tolist():
        p, q, width = int(a[i]) + k, int(b[i]) + k, 64
        while True:
            span = min(width, n - max(p, q))
            unequal = np.flatnonzero(text[p : p + span] != text[q : q + span])
            if len(unequal) or span < width:
                out[i] = p - a[i] + (unequal[0] if len(unequal) else span)
                break
            p, q, width = p + span, q + span, width * 2
    return out


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, its common prefix with the one before it in ``sa``.

    Where the symbols before both suffixes agree, the value is one less than that of the suffix
    to the left; so only the other, irreducible ones are compared.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    if n:
        before[sa[0]] = n
    at = np.arange(n)
    follows = np.zeros(n, bool)
    inner = at[1:][(before[1:] > 0) & (before[1:] < n)]
    follows[inner] = text[inner - 1] == text[before[inner] - 1]
    heads = np.flatnonzero(~follows)
    values = _prefix_lengths(text, heads, before[heads])
    nearest = np.cumsum(~follows) - 1
    return values[nearest] - (at - heads[nearest])
