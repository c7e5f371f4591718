"""Vectorised text kernels on the byte buffers of Arrow string arrays (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are worked on in runs of at most so many bytes (or one text).
CHUNK = 1 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)

#: ``[\x20\x09-\x0D]``: what separates words in the near-duplicate contract.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is neither a letter nor a digit: separators once punctuation is ignored.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Second bytes after 0xC2 of Latin-1 punctuation and blanks (U+0080 to U+00BF without letters and numbers).
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = False

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_PRIME))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get("up")
    if held is None or len(held) < n:
        n = max(n, CHUNK + (1 << 16))
        for name, base in (("up", _PRIME), ("down", _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def runs(array: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with at most ``most`` bytes together, or one longer row. Nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def blanked(data: np.ndarray) -> np.ndarray:
    """UTF-8 with non-ASCII punctuation and blanks overwritten by ASCII blanks: Latin-1 marks, general punctuation
    (U+2000 to U+206F), CJK marks (U+3000 to U+303F but for 3005 to 3007) and full-width ones (U+FF01 to U+FF0F, FF1A, FF1B, FF1F)."""
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < len(data)]
    if not len(lead):
        return data
    first, second = data[lead], data[lead + 1]
    two = lead[(first == 0xC2) & _LATIN[second]]
    wide = lead[lead + 2 < len(data)]
    first, second, third = data[wide], data[wide + 1], data[wide + 2]
    three = (first == 0xE2) & ((second == 0x80) | ((second == 0x81) & (third < 0xB0)))
    three |= (first == 0xE3) & (second == 0x80) & ~((third >= 0x85) & (third <= 0x87))
    three |= (first == 0xEF) & (second == 0xBC) & ((third >= 0x81) & (third <= 0x8F) | np.isin(third, (0x9A, 0x9B, 0x9F)))
    three = wide[three]
    if not len(two) + len(three):
        return data
    out = data.copy()
    out[two] = out[two + 1] = 0x20
    out[three] = out[three + 1] = out[three + 2] = 0x20
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text the index of its first word (plus the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < n)]
    if len(borders):  # a word never runs over the border between two texts
        starts[borders] |= inside[borders]
        ends[borders - 1] |= inside[borders - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _power_table(n)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[FOLD[data] if fold else data] * up[:n], out=total[1:])
    hashes = mix((total[last + 1] - total[first]) * down[first] + (last - first).astype(U))
    return hashes, np.searchsorted(first, offsets)


def shingle_sets(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text (sorted), and offsets. A text of 1 to k-1 words has one shingle: all of it."""
    n_words = np.diff(firsts)
    if len(hashes) >= k:
        windows = np.zeros(len(hashes) - k + 1, U)
        for j in range(k):
            windows = windows * U(_PRIME) + hashes[j : len(hashes) - k + 1 + j]
        windows = mix(windows)
    else:
        windows = np.zeros(0, U)
    parts, sizes = [], np.zeros(len(n_words) + 1, np.int64)
    for i, (at, count) in enumerate(zip(firsts[:-1].tolist(), n_words.tolist(), strict=True)):
        if count >= k:
            own = np.sort(windows[at : at + count - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif count:
            whole = U(count)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + count]:
                    whole = whole * U(_PRIME) + h
            own = mix(np.array([whole], U))
        else:
            continue
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.cumsum(sizes)


def text_sets(array: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, offsets) over all texts of the array, by the near-duplicate contract's words."""
    for row, data, offsets in runs(array):
        yield row, *shingle_sets(*word_hashes(data, offsets, SPACES), k)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
