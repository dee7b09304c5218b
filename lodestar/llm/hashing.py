"""Hashes of words and shingles for whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 (published constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _PRIME)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes, a space after each; and where each begins (and the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(b" ".join([*texts, b""]) if texts else b"", dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts of a column in UTF-8, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def some_texts(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes, each with the place of its first text."""
    size, first = 0, 0
    for at, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, texts[first : at + 1]
            first, size = at + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
        done, top = 1, base
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * _U(top)
            done += more
            top = top * top % (1 << 64)
    return out


_CODED = _BYTE[_LOWER]
_POWERS: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; kept by the process up to a few million."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, 1 << 21)
    made = [powers(int(_PRIME), size), powers(pow(int(_PRIME), -1, 1 << 64), size)]
    if size <= 1 << 23:
        _POWERS[:] = made
    return made[0], made[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and the index of each text's first word (and the end)."""
    data, begins = joined(texts)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    ends = np.flatnonzero(last) + 1
    # A word's hash is the sum of coded letters times rising powers, brought to its own start by inverse powers.
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODED[data] * up[: len(data)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mixed(out + (ends - starts).astype(np.uint64)), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; with fewer words, all of them as one; none without words."""
    h, at = word_hashes(texts)
    n = len(h)
    whole = np.zeros(max(0, n - words + 1), dtype=np.uint64)
    for k in range(words):
        whole = whole * _PRIME + h[k : k + len(whole)]
    whole = mixed(whole + _U(words))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            one = _U(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = one * _PRIME + x
                out.append(mixed(np.array([one + _U(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
