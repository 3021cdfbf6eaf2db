"""Encoding of independent text fragments with a bounded memory of seen ones.

Words repeat, so a worker keeps the ids of the fragments it has met and builds
the ids of a text by array lookups. When the memory is full its less used part goes, which
costs time and never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np

#: Fragments a worker remembers; some 150 bytes each.
REMEMBERED = 250_000
#: Characters encoded at a time; bounds the arrays a worker holds.
CHUNK_CHARS = 1_000_000


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[start[i] : start[i] + length[i]]`` over all i."""
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)]


class Ragged:
    """Rows of different length in one growing array."""

    def __init__(self, dtype) -> None:
        self.flat = np.empty(1 << 16, dtype)
        self.start = np.empty(1 << 14, np.int64)
        self.length = np.empty(1 << 14, np.int64)
        self.rows = self.used = 0

    def extend(self, rows: Sequence[Sequence]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        values = np.fromiter(chain.from_iterable(rows), self.flat.dtype, int(sizes.sum()))
        self.append(values, sizes)

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(sizes) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.length = np.concatenate([self.length, np.empty_like(self.length)])
        at = slice(self.rows, self.rows + len(sizes))
        self.flat[self.used : self.used + len(values)] = values
        self.length[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.rows += len(sizes)
        self.used += len(values)

    def take(self, rows: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start[rows], self.length[rows])


class FragmentEncoder:
    """Ids of texts from ``split`` (text to fragments) and ``encode`` (fragments to ids).

    ``encode(text)`` must equal the concatenated ``encode`` of its fragments, and
    ``segments`` must cut a text only between fragments.
    """

    def __init__(
        self,
        split: Callable[[str], list],
        encode: Callable[[list], list[list[int]]],
        segments: Callable[[str, int], Iterator[str]],
        remembered: int = REMEMBERED,
        chunk: int = CHUNK_CHARS,
    ) -> None:
        self._split, self._encode, self._segments = split, encode, segments
        self._remembered, self._chunk = remembered, chunk
        self._forget()

    def _forget(self) -> None:
        self._row: dict = {}
        self._ids = Ragged(np.int32)
        self._uses = np.zeros(0, np.int64)

    def _keep_frequent(self) -> None:
        """Make room: keep at most the more used half of the fragments."""
        uses = self._uses[: self._ids.rows]
        least = max(2, int(np.partition(uses, -(len(uses) // 2))[-(len(uses) // 2)]))
        kept = [f for f, r in self._row.items() if uses[r] >= least][: self._remembered // 2]
        rows = np.fromiter((self._row[f] for f in kept), np.int64, len(kept))
        old = self._ids
        self._forget()
        self._ids.append(old.take(rows), old.length[rows])
        self._row = dict(zip(kept, range(len(kept)), strict=True))
        self._uses = uses[rows] // 2

    def _rows(self, fragments: list) -> np.ndarray:
        rows = list(map(self._row.get, fragments))
        if None in rows:
            new = list(dict.fromkeys(f for f, r in zip(fragments, rows, strict=True) if r is None))
            moved = len(self._row) + len(new) > self._remembered and len(self._row) > 1
            if moved:
                self._keep_frequent()
                new = [f for f in dict.fromkeys(fragments) if f not in self._row]
            self._row.update(zip(new, range(self._ids.rows, self._ids.rows + len(new)), strict=True))
            self._ids.extend(self._encode(new))
            row = self._row
            rows = [row[f] if r is None or moved else r for f, r in zip(fragments, rows, strict=True)]
        rows = np.array(rows, np.int64)
        uses = np.bincount(rows, minlength=self._ids.rows)
        uses[: len(self._uses)] += self._uses
        self._uses = uses
        return rows

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        fragments: list = []
        ends = []
        for text in texts:
            fragments += self._split(text)
            ends.append(len(fragments))
        rows = self._rows(fragments)
        ids = self._ids.take(rows)
        upto = np.concatenate([[0], np.cumsum(self._ids.length[rows])])
        first = 0
        for end in ends:
            yield ids[upto[first] : upto[end]]
            first = end

    def __call__(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """One id array per text, in order; a null text has no ids."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > self._chunk:
                yield from self._together(waiting)
                waiting, size = [], 0
                parts = [p for s in self._segments(text, self._chunk) for p in self._together([s])]
                yield np.concatenate(parts)
                continue
            if size + len(text) > self._chunk:
                yield from self._together(waiting)
                waiting, size = [], 0
            waiting.append(text)
            size += len(text)
        yield from self._together(waiting)
