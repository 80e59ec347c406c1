"""Periodic runs of words, caught online by catchers over completed power-of-two blocks.

A run is a stretch of consecutive words with smallest period q that has at least
``max(shortest, repeats * q)`` words and that no neighbouring word extends. Words
are appended to a ``Catcher`` in any number of steps. A block of 2**k words that
begins at a multiple of 2**k becomes a catcher once it is complete: as words
arrive, the fingerprint of the last 2**k words is compared with those of the
blocks at the distances that belong to their size. A hit is checked word by word
and grown to both sides; repetitions met from several blocks are one stretch.

In a stretch of length L and period q, L - q words return q words later. If L is at
least ``repeats * q``, an aligned block of 2**k words fits among them as long as
2**(k+1) - 1 <= (repeats - 1) * q. Each distance is left to the largest such block,
so all blocks of a size look at fewer distances together than there are words:
O(n log n) comparisons for n words.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: A run has at least so many words, and so many periods.
SHORTEST, REPEATS = 6, 4
#: Words of the first step; later steps are as long as all before them. Fingerprints compared at a time.
STEP, COMPARED = 1 << 20, 1 << 19
#: Base of the prefix polynomials modulo 2**64 and its inverse; a factor that spreads word numbers.
_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)

Run = tuple[int, int, int]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Catcher:
    """Runs of a growing sequence of words, given as whole numbers that are equal for equal words."""

    def __init__(self, shortest: int = SHORTEST, repeats: int = REPEATS) -> None:
        if repeats < 2 or shortest < 1:
            raise ValueError("a run holds its period at least twice")
        self.shortest, self.repeats = shortest, repeats
        self.words = np.zeros(0, np.int64)
        self.prefix, self.inverse, self.power = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
        #: Period -> starts in order, and (period, start) -> end, of the runs and of what may become one.
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray, last: bool = False) -> None:
        """The next words; after the ``last`` ones, distances too long for a run are left out."""
        old = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        n = len(self.words)
        self.power, self.inverse = _powers(_BASE, n), _powers(_INVERSE, n)
        added = (self.words[old:].astype(np.uint64) + np.uint64(1)) * _SPREAD * self.power[old:n]
        self.prefix = np.concatenate([self.prefix, self.prefix[-1] + np.cumsum(added, dtype=np.uint64)])
        for (q, start), end in list(self.ends.items()):
            if end == old:  # it reached the last word, so it may go on
                self.ends[q, start] = self._right(old, q)
                self._forget(q, start, n)
        size = 1
        while True:
            low, high = (-(-(k * size - 1) // (self.repeats - 1)) for k in (2, 4))
            high = min(high, n - size + 1, n // self.repeats + 1 if last else n)
            if low + size > n or last and low * self.repeats > n:
                return
            if low < high:
                self._look(size, low, high, old)
            size *= 2

    def _marks(self, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the ``size`` words from each place on."""
        return (self.prefix[at + size] - self.prefix[at]) * self.inverse[at]

    def _look(self, size: int, low: int, high: int, old: int) -> None:
        """Compares complete blocks with what stands ``low`` to ``high - 1`` words after them and ends in new words."""
        n = len(self.words)
        first = max(0, old - size - high + 2) // size * size
        blocks, distances = np.arange(first, n - size - low + 1, size), np.arange(low, high)
        for at in range(0, len(blocks), wide := max(1, COMPARED // len(distances))):
            part = blocks[at : at + wide]
            begun, stopped = int(part[0]), min(n - size, int(part[-1]) + high - 1)
            marks = self._marks(np.arange(begun, stopped + 1), size)
            places = part[:, None] + distances[None, :]
            hits = marks[np.minimum(places, stopped) - begun] == marks[part - begun][:, None]
            hits &= (places <= n - size) & (places > old - size)
            row, column = np.nonzero(hits.T)[::-1]
            if len(row):
                self._grow(part[row], distances[column], size)

    def _grow(self, blocks: np.ndarray, distances: np.ndarray, size: int) -> None:
        """Hits, by distance and block, become stretches if their words agree."""
        w, at = self.words, 0
        while at < len(blocks):
            b, q = int(blocks[at]), int(distances[at])
            end = self._known(b, b + q + size, q)
            if not end and (w[b : b + size] == w[b + q : b + q + size]).all():
                start, end = self._left(b, q), self._right(b + q + size, q)
                if (q, start) not in self.ends:
                    insort(self.starts.setdefault(q, []), start)
                self.ends[q, start] = end
                self._forget(q, start, len(w))
            # The other blocks of this distance inside the stretch say nothing new.
            last = at + int(np.searchsorted(distances[at:], q, "right"))
            at = max(at + 1, at + int(np.searchsorted(blocks[at:last], end - q - size, "right")))

    def _known(self, start: int, end: int, q: int) -> int:
        """The end of a stretch over all these words whose period divides q, or 0."""
        for p, starts in self.starts.items():
            if q % p == 0 and (i := bisect_right(starts, start)) and self.ends[p, starts[i - 1]] >= end:
                return self.ends[p, starts[i - 1]]
        return 0

    def _forget(self, q: int, start: int, n: int) -> None:
        """Drops what is too short and has ended."""
        end = self.ends[q, start]
        if end < n and end - start < max(self.shortest, self.repeats * q):
            del self.ends[q, start]
            self.starts[q].remove(start)
            if not self.starts[q]:
                del self.starts[q]

    def _right(self, at: int, q: int) -> int:
        """The end of the stretch that holds period q up to here."""
        w, n, step = self.words, len(self.words), 16
        while at < n:
            to = min(n, at + step)
            differs = w[at:to] != w[at - q : to - q]
            if differs.any():
                return at + int(differs.argmax())
            at, step = to, 2 * step
        return n

    def _left(self, at: int, q: int) -> int:
        """The start of the stretch that holds period q from here on."""
        w, step = self.words, 16
        while at > 0:
            to = max(0, at - step)
            differs = (w[to:at] != w[to + q : at + q])[::-1]
            if differs.any():
                return at - int(differs.argmax())
            at, step = to, 2 * step
        return 0

    def runs(self) -> list[Run]:
        """(start, length, period) of the runs so far, by start and period."""
        long = {(q, s): e for (q, s), e in self.ends.items() if e - s >= max(self.shortest, self.repeats * q)}
        return sorted((s, e - s, q) for (q, s), e in long.items() if not self._shorter(s, e, q))

    def _shorter(self, start: int, end: int, q: int) -> bool:
        """Whether the stretch has a smaller period, which then divides q."""
        return any(
            p < q and q % p == 0 and (i := bisect_right(starts, start)) and self.ends[p, starts[i - 1]] >= end
            for p, starts in self.starts.items()
        )


def runs_of(words: list, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[Run]:
    """The runs of a list of words, in its order."""
    seen: dict = {}
    numbers = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    catcher, at, step = Catcher(shortest, repeats), 0, STEP
    while at < len(numbers):
        catcher.append(numbers[at : at + step], last=at + step >= len(numbers))
        at, step = at + step, max(step, at + step)
    return catcher.runs()


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    best = None
    for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or length * best[2] > best[1] * q:
            best = s, length, q
    return best


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that stand in any run after its first period."""
    stops: list[tuple[int, int]] = sorted((s + q, s + length) for s, length, q in runs)
    kept, at = [], 0
    for start, end in stops:
        kept += words[at : max(at, start)]
        at = max(at, end)
    return kept + words[at:]


_SCHEMA = (
    "doc_id {}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start: long, length: long, period: long>>, runs_sha256 string, collapsed string, collapsed_sha256 string"
)
_PLACES = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
Change = Callable[[list[bytes], int | None], list[bytes]]


def find(docs: DataFrame, change: Change | None = None, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): its runs, the strongest one, digests, and the text without repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared by their bytes and counted from 0; ``change`` may give other
    words in their place, from the words and the doc_id. Texts that are null, empty or all white space have no
    words: no runs, nulls for the strongest one, an empty ``collapsed``. Repeated rows are answered each, other
    columns are left out. Nothing is shuffled and a document is the largest unit any task holds.
    """
    C.prepare(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in (b.slice(at, 16) for b in batches for at in range(0, b.num_rows, 16)):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), C.texts(b.column(1)), strict=True):
                words = text.encode().split()  # the white space of bytes is that of the words
                words = change(words, doc_id) if change else words
                runs = runs_of(words, shortest, repeats)
                best = strongest(runs) or (None, None, None)
                kept = b" ".join(collapsed(words, runs))
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                rows.append((
                    len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs],
                    hashlib.sha256(listed.encode()).hexdigest(), kept.decode(), hashlib.sha256(kept).hexdigest(),
                ))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA.format(key))


_NAMES = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed", "collapsed_sha256"]
_TYPES = [*[pa.int64()] * 6, _PLACES, pa.string(), pa.string(), pa.string()]
