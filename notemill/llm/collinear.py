"""Chains and alignments of many pairs of texts at once.

The same steps as ``passages.chains`` and ``passages.align`` take for one pair, on arrays: anchors of all pairs, the best
predecessor of each, chains from the best end on, extension on both sides, differences between the anchors.
Pairs with the same number of anchors (filled up to a few sizes) are handled together. Words are numbers here.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96)   # anchors of the pairs that are chained together
CELLS = 1 << 19          # cells of an array that is held at once


class Chains(NamedTuple):
    """Chains one after another: the pair of each, where its anchors begin, and the anchors (left, right, length)."""

    pair: np.ndarray
    start: np.ndarray    # one more than there are chains
    a: np.ndarray
    b: np.ndarray
    n: np.ndarray


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes one after another: the run of each entry, and its place in it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]


def _best_chains(pair, a, b, n, alive, k, max_gap, found):
    """All chains of pairs (rows) over their anchors (columns, ordered); see ``passages.chains``."""
    while len(pair):
        rows, width = np.arange(len(pair)), a.shape[1]
        ea, eb, mid = a + n, b + n, (a + b) / 2
        score, back = np.where(alive, n, -np.inf), np.full(a.shape, -1)
        value = np.where(alive, n + mid + n, -np.inf)
        for i in range(1, width):
            ok = (ea[:, :i] <= a[:, i:i + 1]) & (eb[:, :i] <= b[:, i:i + 1])
            v = np.where(ok, value[:, :i], -np.inf)
            j = i - 1 - v[:, ::-1].argmax(1)   # of equal ones the last
            gain = v[rows, j] - mid[:, i]
            link = alive[:, i] & (gain > 0) & (a[:, i] - ea[rows, j] <= max_gap) & (b[:, i] - eb[rows, j] <= max_gap)
            if link.any():
                more = np.where(link, gain, 0)
                score[:, i] += more
                value[:, i] += more
                back[link, i] = j[link]
        at = score.argmax(1)
        inside, last, first = np.zeros(a.shape, bool), at, at
        here, cur = rows, at
        while len(here):
            inside[here, cur] = True
            first = first.copy()
            first[here] = cur
            cur = back[here, cur]
            here, cur = here[cur >= 0], cur[cur >= 0]
        usable = (inside.sum(1) > 1) | (n[rows, at] > k)
        if usable.any():
            kept = inside[usable]
            found.append((pair[usable], kept.sum(1), a[usable][kept], b[usable][kept], n[usable][kept]))
        a0, b0, a1, b1 = a[rows, first], b[rows, first], ea[rows, last], eb[rows, last]
        alive = alive & ~inside & ((a >= a1[:, None]) | (ea <= a0[:, None])) & ((b >= b1[:, None]) | (eb <= b0[:, None]))
        # where the best is a single seed, no others can be linked
        go = alive.any(1) & (score[rows, at] > k)
        pair, a, b, n, alive = pair[go], a[go], b[go], n[go], alive[go]


def chains(pair: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, window: int, max_gap: int, one) -> Chains:
    """Usable chains of matches (pair, left, right) of short seeds; ``one`` chains a pair of very many anchors."""
    order = np.lexsort((left, left - right, pair))
    pair, left, right = pair[order], left[order], right[order]
    if len(pair):
        new = np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0)])
        pair, left, right = pair[new], left[new], right[new]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(left - right) != 0) | (np.diff(left) > window)])) \
        if len(pair) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(left)) - 1 if len(cut) else cut
    p, a, b, n = pair[cut], left[cut], right[cut], left[last] - left[cut] + k
    order = np.lexsort((n, b, a, p))
    p, a, b, n = p[order], a[order], b[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(p) != 0])) if len(p) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(p)))
    found = []
    kind = np.searchsorted(SIZES, sizes)
    # one anchor
    single = begin[sizes == 1]
    single = single[n[single] > k]
    found.append((p[single], np.ones(len(single), np.int64), a[single], b[single], n[single]))
    for c in np.unique(kind):
        of = np.flatnonzero((kind == c) & (sizes > 1))
        if c == len(SIZES):
            for i in of:
                s = slice(begin[i], begin[i] + sizes[i])
                for chain in one(list(zip(a[s].tolist(), b[s].tolist(), n[s].tolist()))):
                    if len(chain) > 1 or chain[0][2] > k:
                        x = np.array(chain, np.int64)
                        found.append((p[s][:1], np.array([len(x)]), x[:, 0], x[:, 1], x[:, 2]))
            continue
        width = SIZES[c]
        for at in range(0, len(of), step := max(1, CELLS // (width * width))):
            rows = of[at:at + step]
            cols = np.arange(width)
            alive = cols < sizes[rows][:, None]
            index = np.where(alive, begin[rows][:, None] + cols, 0)
            _best_chains(p[begin[rows]], a[index], b[index], n[index], alive, k, max_gap, found)
    count = np.concatenate([f[1] for f in found])
    return Chains(np.concatenate([f[0] for f in found]), np.concatenate([[0], np.cumsum(count)]).astype(np.int64),
                  *(np.concatenate([f[i] for f in found]) for i in (2, 3, 4)))


def _extended(words, left, right, room, step, margin, drop):
    """How far words from these places on run on together, and with how many differences; see ``passages._extend``."""
    length, wrong = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    k = np.arange(margin)
    for s in range(0, len(left), size := max(1, CELLS // margin)):
        r = room[s:s + size]
        ok = k < r[:, None]
        x, y = (np.where(ok, v[s:s + size, None] + step * k, 0) for v in (left, right))
        differ = words[x] != words[y]
        score = np.cumsum(np.where(ok, np.where(differ, -3, 1), -drop - 2 * margin), 1, dtype=np.int32)
        best = np.maximum(np.maximum.accumulate(score, 1), 0)
        score[np.logical_or.accumulate(score < best - drop, 1)] = -1
        at = score.argmax(1)
        rows = np.arange(len(r))
        some = score[rows, at] > 0
        length[s:s + size] = np.where(some, at + 1, 0)
        wrong[s:s + size] = np.where(some, np.cumsum(differ, 1)[rows, at], 0)
    return length, wrong


def _differing(words, x, y, size):
    """The number of differing words of runs of one size on both sides, one for one."""
    out = np.zeros(len(x), np.int64)
    ends = np.cumsum(size)
    s = 0
    while s < len(x):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 4 * CELLS, "right")))
        owner, at = ragged(size[s:e])
        differ = words[x[s:e][owner] + at] != words[y[s:e][owner] + at]
        out[s:e] = np.bincount(owner[differ], minlength=e - s)
        s = e
    return out


def _distance(words, x, m, y, n):
    """Edit distances of the words from x on, m of them, to those from y on, n of them; see ``passages._edits``."""
    out = np.maximum(m, n)
    todo = np.flatnonzero((m > 0) & (n > 0))
    todo = todo[np.lexsort((n[todo], m[todo]))]
    s = 0
    while s < len(todo):
        e = s + max(1, CELLS // (int(n[todo[s:s + CELLS // 64]].max()) + 1))
        rows = todo[s:e]
        s = e
        high, wide = int(m[rows].max()), int(n[rows].max())
        left = words[np.minimum(x[rows][:, None] + np.arange(high), len(words) - 1)]
        right = words[np.minimum(y[rows][:, None] + np.arange(wide), len(words) - 1)]
        step = np.arange(wide + 1, dtype=np.int32)
        row = np.repeat(step[None, :], len(rows), 0)
        for i in range(1, high + 1):
            new = np.empty_like(row)
            new[:, 0] = i
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (left[:, i - 1:i] != right), out=new[:, 1:])
            row = np.minimum.accumulate(new - step, 1) + step
            ended = np.flatnonzero(m[rows] == i)
            out[rows[ended]] = row[ended, n[rows[ended]]]
    return out


def align(words: np.ndarray, left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, found: Chains,
          margin: int, drop: int, least: int) -> tuple[np.ndarray, ...]:
    """Passages of chains: (chain, start and length on both sides, share of alike words) of those with ``least`` words.

    ``left`` and ``right`` are the places in ``words`` where the texts of each chain begin, with their sizes in words.
    """
    first, last = found.start[:-1], found.start[1:] - 1
    a0, b0, a1, b1 = found.a[first], found.b[first], found.a[last] + found.n[last], found.b[last] + found.n[last]
    back, wrong = _extended(words, left + a0 - 1, right + b0 - 1, np.minimum(a0, b0), -1, margin, drop)
    on, wrong_on = _extended(words, left + a1, right + b1, np.minimum(left_size - a1, right_size - b1), 1, margin, drop)
    a0, b0 = a0 - back, b0 - back
    la, lb = a1 + on - a0, b1 + on - b0
    keep = np.flatnonzero(np.minimum(la, lb) >= least)
    # anchors of the chains that are long enough, and the gaps before all but the first of each
    owner, at = ragged(found.start[keep + 1] - found.start[keep])
    i = found.start[keep][owner] + at
    l0, r0 = left[keep][owner], right[keep][owner]
    edits = np.bincount(owner, _differing(words, l0 + found.a[i], r0 + found.b[i], found.n[i]), len(keep))
    gap = np.flatnonzero(at > 0)
    j = i[gap] - 1
    x, y = found.a[j] + found.n[j], found.b[j] + found.n[j]
    m, n, x, y = found.a[i[gap]] - x, found.b[i[gap]] - y, x + l0[gap], y + r0[gap]
    between = np.zeros(len(gap), np.int64)
    even = m == n
    between[even] = _differing(words, x[even], y[even], m[even])
    odd = np.flatnonzero(~even | (between > 2))   # up to two differences one for one cannot be fewer otherwise
    between[odd] = _distance(words, x[odd], m[odd], y[odd], n[odd])
    edits += np.bincount(owner[gap], between, len(keep))
    share = 1 - (edits + wrong[keep] + wrong_on[keep]) / np.maximum(la, lb)[keep]
    return keep, a0[keep], la[keep], b0[keep], lb[keep], share
