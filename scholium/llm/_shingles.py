"""Sets of word shingles as sorted 64-bit hashes, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[_SPACE] = 0
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes handled at a time; longer texts are cut at white space and their words joined again.
SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SEGMENT + 2)
        _powers[:] = []
        for base in (_P, _PINV):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def _words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.concatenate([[True], _SPACE[a], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of bytes between ASCII white space, where they start and where they end."""
    got, at = [], 0
    while at < len(a):
        to = min(len(a), at + SEGMENT)
        if to < len(a):
            gaps = np.flatnonzero(_SPACE[a[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one word longer than a segment
                gaps = np.flatnonzero(_SPACE[a[to:]])
                to = to + int(gaps[0]) + 1 if len(gaps) else len(a)
        h, start, end = _words(a[at:to])
        got.append((h, start + at, end + at))
        at = to
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*got))


def shingle_sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than `width`, one hash of all; without words, none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to] or b"") < SEGMENT):
            size += len(texts[to] or b"") + 1
            to += 1
        out += _sets([t or b"" for t in texts[at:to]], width)
        at = to
    return out


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    a = np.frombuffer(b" ".join(texts).translate(_LOWER), np.uint8)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    h, s, _ = words(a)
    bounds = np.searchsorted(s, first)
    n = len(h) - width + 1
    run = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        run += h[j : j + n] * _PLACE[j]
    run = mix(run)
    out = []
    for k in range(len(texts)):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        if hi - lo >= width:
            x = np.sort(run[lo : hi - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif hi > lo:
            x = (h[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
