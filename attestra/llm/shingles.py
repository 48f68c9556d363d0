"""Word-shingle sets as sorted arrays of 64-bit hashes, made in numpy from UTF-8 bytes.

Words are runs of anything but ASCII white space, A-Z in lower case. A word's hash is a polynomial over a table of
random values per byte, finished by a mixer; a shingle's hash combines those of its words with the place of each.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(_ODD))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 20, n)
        with np.errstate(over="ignore"):
            _POWERS[:] = [
                np.concatenate([[_U(1)], np.full(size - 1, _U(step), _U)]).cumprod(dtype=_U) for step in (_ODD, _INVERSE)
            ]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more entry than texts)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b" ".join([*data, b""]) if data else b"", np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    if not len(joined):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    gap = _SPACE[joined]
    edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(joined) + 1)
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[joined] * power[: len(joined)], dtype=_U)])
        hashes = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles; a shorter text is one shingle, none without words."""
    hashes, bounds = word_hashes(texts)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(hashes) - width + 1), _U)
        for k in range(width):
            runs += hashes[k : k + len(runs)] * _U(pow(_ODD, 2 * k + 3, 1 << 64))
        runs = _mix(runs)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(runs[a : b - width + 1]))
            elif b > a:
                out.append(_mix(np.array([np.sum(hashes[a:b] * power_of(b - a)) + _U(b - a)], _U)))
            else:
                out.append(np.zeros(0, _U))
    return out


def power_of(n: int) -> np.ndarray:
    return np.array([pow(_ODD, 2 * k + 3, 1 << 64) for k in range(n)], _U)
