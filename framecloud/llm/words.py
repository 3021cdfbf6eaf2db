"""Word hashes of a text, computed for all its words at once."""

from __future__ import annotations

import numpy as np

#: Bytes hashed together; powers are kept for so many places.
SEGMENT = 1 << 18

_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * _K2
    h = (h ^ (h >> np.uint64(27))) * _K3
    return h ^ (h >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POWER = _powers(int(_K1), SEGMENT + 1)
_INVERSE = _powers(pow(int(_K1), -1, 1 << 64), SEGMENT + 1)

#: Bytes between words: ASCII white space, or that and all ASCII marks.
NOT_SPACE = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def _hashes(codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    flags = np.zeros(len(codes) + 2, np.int8)
    flags[1:-1] = inside
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    start, end = edges[::2], edges[1::2]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _POWER[: len(codes)], out=total[1:])
    h = (total[end] - total[start]) * _INVERSE[start]
    return mix(h + (end - start).astype(np.uint64) * _K3)


def word_hashes(text: str | None, word_bytes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased words in order; null has none.

    Words are runs of ``word_bytes`` in UTF-8. A word longer than ``SEGMENT`` bytes
    is cut there.
    """
    codes = np.frombuffer((text or "").lower().encode(), np.uint8)
    inside = word_bytes[codes]
    if len(codes) <= SEGMENT:
        return _hashes(codes, inside)
    parts, at = [], 0
    while at < len(codes):
        end = min(at + SEGMENT, len(codes))
        if end < len(codes):
            gaps = np.flatnonzero(~inside[at:end])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        parts.append(_hashes(codes[at:end], inside[at:end]))
        at = end
    return np.concatenate(parts)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    count = len(h) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out += h[k : k + count] * _POWER[k + 1]
    return mix(out)
