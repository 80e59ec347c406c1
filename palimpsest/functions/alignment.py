"""Alignment of two word lists: the matching blocks of ``difflib.SequenceMatcher``, found on arrays."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Pairs of equal words held at once; above, the same blocks come from difflib, slowly but in little memory.
MOST_PAIRS = 8_000_000
#: Up to so many words in both lists together difflib is as fast.
FEW_WORDS = 1_000


def _rare(b: np.ndarray, words: int) -> np.ndarray:
    """How often each word stands in ``b``, without those that difflib takes for popular."""
    count = np.bincount(b, minlength=words)
    if len(b) >= 200:
        count[count > len(b) // 100 + 1] = 0
    return count


def _runs(a: np.ndarray, b: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Start in a, start in b and length of all longest runs of equal rare words."""
    reps = count[a]
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], a)
    i = np.repeat(np.arange(len(a)), reps)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first, reps)]
    rare = count > 0
    # Ends that equal no word and each other neither.
    x, y = np.concatenate(([-1], a, [-1])), np.concatenate(([-2], b, [-2]))
    known = np.concatenate(([False], rare[a], [False]))
    opens = ~(known[i] & (x[i] == y[j]))
    closes = ~(known[i + 2] & (x[i + 2] == y[j + 2]))
    far = len(a) + len(b) + 2

    def along(chosen: np.ndarray) -> np.ndarray:
        chosen = np.flatnonzero(chosen)
        return chosen[np.argsort((j[chosen] - i[chosen]) * far + i[chosen], kind="stable")]

    starts, ends = along(opens), along(closes)
    return np.stack((i[starts], j[starts], i[ends] - i[starts] + 1))


def blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """``SequenceMatcher(None, a, b).get_matching_blocks()`` of two arrays of small whole numbers."""
    words = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    count = _rare(b, words)
    if len(a) + len(b) <= FEW_WORDS or count[a].sum() > MOST_PAIRS:
        return [tuple(m) for m in SequenceMatcher(None, a.tolist(), b.tolist()).get_matching_blocks()]
    old, new, found = a.tolist(), b.tolist(), []
    rest = [(0, len(old), 0, len(new), _runs(a, b, count))]
    while rest:
        alo, ahi, blo, bhi, runs = rest.pop()
        # What of each run lies inside.
        skip = np.maximum(0, np.maximum(alo - runs[0], blo - runs[1]))
        size = np.minimum(runs[2], np.minimum(ahi - runs[0], bhi - runs[1])) - skip
        inside = size > 0
        runs = np.stack(((runs[0] + skip)[inside], (runs[1] + skip)[inside], size[inside]))
        i, j, k = alo, blo, 0
        if runs.shape[1]:
            k = int(runs[2].max())
            best = runs[:2, runs[2] == k]
            at = np.lexsort((best[1], best[0]))[0]
            i, j = int(best[0, at]), int(best[1, at])
        # Popular words next to it belong to the block.
        while k and i > alo and j > blo and old[i - 1] == new[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and old[i + k] == new[j + k]:
            k += 1
        if not k:
            continue
        found.append((i, j, k))
        if alo < i and blo < j:
            rest.append((alo, i, blo, j, runs[:, (runs[0] < i) & (runs[1] < j)]))
        if i + k < ahi and j + k < bhi:
            rest.append((i + k, ahi, j + k, bhi, runs[:, (runs[0] + runs[2] > i + k) & (runs[1] + runs[2] > j + k)]))
    out: list[tuple[int, int, int]] = []
    for i, j, k in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return [*out, (len(old), len(new), 0)]


def cuts(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Where words of ``a`` are deleted or replaced: their range in a and what stands there in b."""
    out, i, j = [], 0, 0
    for x, y, k in blocks(a, b):
        if i < x:
            out.append((i, x, j, y))
        i, j = x + k, y + k
    return out
