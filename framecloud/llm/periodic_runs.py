"""Periodic runs of words: stretches that repeat a block of words at least four times.

Two words q apart are compared at every q-th place (a harmonic grid: n/q places for each
period q, some n log n in all). Places where a few words agree are extended in both
directions by longest common extensions, which give the whole run. Extensions come from
a difference cover: only suffixes at places in the cover are sorted; any two places reach
the cover together within a few words, which are compared directly, and the sorted
suffixes answer the rest through minima of their common prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framecloud.llm.schemas import fields_of

#: Times a block is there at least, and words of the shortest run.
REPEATS, SHORTEST = 4, 6
#: A perfect difference set: any two residues meet in it after exactly one shift.
CYCLE, COVER = 13, (0, 1, 3, 9)
#: Words of the documents searched together; a longer document is searched alone.
TOGETHER = 300_000
#: Extensions computed at a time.
PAIRS = 1 << 18

_SHIFT = np.array([next(x for x in COVER if (x + k) % CYCLE in COVER) for k in range(CYCLE)])
_IN_COVER = np.isin(np.arange(CYCLE), COVER)


class CoverExtensions:
    """Longest common extensions to the right of places in an array of words.

    Documents in the array end with a word found nowhere else, so extensions end there.
    """

    def __init__(self, words: np.ndarray) -> None:
        n = len(words) + 1  # with one word found nowhere else behind the last
        self._padded = np.concatenate([words, -n - np.arange(CYCLE + 1)])
        places = np.flatnonzero(_IN_COVER[np.arange(n) % CYCLE])
        #: Row of each covered place among the covered places, by residue and then place,
        #: so that the covered place one cycle on is the next row.
        order = np.lexsort([places, places % CYCLE])
        self._row = np.full(n, -1, np.int64)
        self._row[places[order]] = np.arange(len(places))
        self._sort(places[order])

    def _blocks(self, places: np.ndarray) -> np.ndarray:
        """Equal numbers for equal runs of ``CYCLE`` words, unequal ones for others."""
        multiplier = np.uint64(0x9E3779B97F4A7C15)
        while True:
            h = np.zeros(len(places), np.uint64)
            for k in range(CYCLE):
                h = (h ^ self._padded[places + k].astype(np.uint64)) * multiplier
                h ^= h >> np.uint64(29)
            _, first, number = np.unique(h, return_index=True, return_inverse=True)
            like = places[first][number]
            if all((self._padded[places + k] == self._padded[like + k]).all() for k in range(CYCLE)):
                return number
            multiplier += np.uint64(2)

    def _sort(self, places: np.ndarray) -> None:
        """Ranks of the covered suffixes in blocks of a cycle, and minima of common prefixes."""
        m = len(places)
        step = 1
        last = np.diff(places % CYCLE, append=-1) != 0  # no covered place one cycle on
        name = self._blocks(places)
        levels = [name]
        ends = np.flatnonzero(last)
        left = ends[np.searchsorted(ends, np.arange(m))] - np.arange(m)  # blocks after this one
        while m and levels[-1].max() < m - 1:
            after = np.where(left >= step, np.append(name[step:], np.zeros(min(step, m), np.int64))[:m], -1)
            name = np.unique(name * (m + 1) + after + 1, return_inverse=True)[1]
            levels.append(name)
            step *= 2
        self._rank = name
        by_rank = np.argsort(name, kind="stable")
        a, b = by_rank[:-1].copy(), by_rank[1:].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < m) & (b < m)
            same = np.zeros(len(a), bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            common[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        self._minima = [common.astype(np.int32)]
        while 2 << (len(self._minima) - 1) <= len(common):
            half = 1 << (len(self._minima) - 1)
            low = self._minima[-1]
            self._minima.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` and from ``b`` on; ``a`` and ``b`` must differ."""
        parts = [self._extend(a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
        return np.concatenate([np.empty(0, np.int64), *parts])

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree, of the first ``most`` each."""
        same = np.zeros(len(a), np.int64)
        alive = np.flatnonzero(most > 0)
        k = 0
        while len(alive):
            alive = alive[self._padded[a[alive] + k] == self._padded[b[alive] + k]]
            same[alive] += 1
            k += 1
            alive = alive[most[alive] > k]
        return same

    def _extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shift = (_SHIFT[(b - a) % CYCLE] - a) % CYCLE
        found = self._compare(a, b, shift)
        on = np.flatnonzero(found == shift)  # both reached the cover; neither left its document
        ra, rb = (self._rank[self._row[x[on] + shift[on]]] for x in (a, b))
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        blocks = np.zeros(len(on), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self._minima[k]
            blocks[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        found[on] += blocks * CYCLE
        rest = self._compare(a[on] + found[on], b[on] + found[on], np.full(len(on), CYCLE))
        found[on] += rest
        return found


def _grid(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i of the grid of each period q where the first words of i and i + q agree.

    Documents lie in falling order of size, so those long enough for q lie in front. A
    run of period q holds a place of the grid from which 2 q words agree.
    """
    ends = np.cumsum(sizes + 1)
    at, period = [], []
    for q in range(1, int(sizes[0]) // REPEATS + 1 if len(sizes) else 1):
        n = int(ends[np.searchsorted(-sizes, -max(REPEATS * q, SHORTEST), side="right") - 1])
        i = np.flatnonzero(words[: n - q : q] == words[q:n:q]) * q
        for k in range(1, min(2 * q, 4)):
            i = i[i + q + k < n]
            i = i[words[i + k] == words[i + q + k]]
        if len(i):
            at.append(i)
            period.append(np.full(len(i), q))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *at]), np.concatenate([empty, *period])


def _joined(docs: Sequence[np.ndarray]) -> np.ndarray:
    """Documents one after the other, each closed by a word of its own."""
    closed = [part for k, d in enumerate(docs) for part in (d, [-1 - k])]
    return np.concatenate([*closed, np.empty(0, np.int64)]).astype(np.int64)


def _runs_together(docs: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Document number, start, length and period of every run of documents of falling size."""
    sizes = np.array([len(d) for d in docs], np.int64)
    at, period = _grid(_joined(docs), sizes)
    # Only documents in which words agree somewhere on the grid need sorted suffixes.
    starts = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(starts, at, side="right") - 1
    inside = at + period < starts[doc] + sizes[doc]  # no run goes on into the next document
    at, period, doc = at[inside], period[inside], doc[inside]
    used = np.unique(doc)
    words = _joined([docs[k] for k in used])
    moved = np.cumsum(sizes[used] + 1) - sizes[used] - 1
    at = at - starts[doc] + moved[np.searchsorted(used, doc)]
    far = CoverExtensions(words)(at, at + period)
    kept = far >= np.where(period == 1, SHORTEST - 1, 2 * period)
    at, period, far = at[kept], period[kept], far[kept]
    back = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > 0)
    if len(inner):
        mirror = CoverExtensions(np.ascontiguousarray(words[::-1]))
        n = len(words)
        back[inner] = mirror(n - at[inner], n - at[inner] - period[inner])
    start, length = at - back, back + period + far
    long = length >= np.maximum(SHORTEST, REPEATS * period)
    start, length, period = start[long], length[long], period[long]
    # The same stretch is found at several places, and with multiples of its period.
    order = np.lexsort([period, length, start])
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    doc = np.searchsorted(moved, start, side="right") - 1
    start = start - moved[doc]
    order = np.lexsort([period, start, doc])
    return used[doc[order]], start[order], length[order], period[order]


def runs_of(docs: Sequence[Sequence]) -> Iterator[np.ndarray]:
    """The runs of each list of words: rows of start, length and period, in that order."""
    numbers: dict = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in d], np.int64) for d in docs]
    order = sorted(range(len(docs)), key=lambda k: -len(coded[k]))
    found: list = [np.empty((0, 3), np.int64)] * len(docs)
    waiting: list[int] = []
    size = 0
    for position, k in enumerate(order):
        waiting.append(k)
        size += len(coded[k])
        if size >= TOGETHER or position == len(order) - 1:
            doc, *columns = _runs_together([coded[j] for j in waiting])
            rows = np.stack(columns, axis=1)
            bounds = np.searchsorted(doc, np.arange(len(waiting) + 1))
            for j, a, b in zip(waiting, bounds[:-1], bounds[1:], strict=True):
                found[j] = rows[a:b]
            waiting, size = [], 0
    return iter(found)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(depth[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept, strict=True) if k])


def find_runs(
    df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed"
) -> DataFrame:
    """Add every run of the text's words and the text with each run cut to its first block.

    Words lie between blanks, tabs and line ends and are numbered from 0. A run is a
    stretch of words with smallest period q, at least 4 q and at least 6 words long, that
    cannot be extended. ``runs`` is an array of start, length and period, ordered by start,
    then period; ``collapsed`` joins the words that stay by one blank. A null or blank text
    has no runs and an empty ``collapsed``. Rows, repeated ones too, and other columns
    stay; existing columns of the added names are replaced.
    """
    df = df.drop(*[c for c in (runs, collapsed) if c != text])
    names = df.columns
    row = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(names.index(text)).to_pylist()]
            found = list(runs_of(words))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([np.empty((0, 3), np.int64), *found])
            cells = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(row))
            texts = [_collapsed(w, r).decode() for w, r in zip(words, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), cells), pa.array(texts, pa.string())],
                [*names, runs, collapsed],
            )

    added = f"`{runs}` array<struct<start:bigint,length:bigint,period:bigint>>, `{collapsed}` string"
    return df.mapInArrow(run, f"{fields_of(df)}, {added}")
