"""Words and shingles of many texts at once, as numpy arrays.

A batch of texts is one UTF-8 buffer; words, their 64-bit hashes and the hashes
of word runs come from array operations over that buffer, so no Python loop
runs per word. A hash is a polynomial in the word's bytes modulo 2**64 that is
then mixed; equal words always hash alike, and unlike words differ except with
a chance near 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (a new array)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and each row's borders in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, borders - borders[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: start, end (byte places), row, and hash once A-Z are lower-cased."""

    def __init__(self, column, lower: bool = True):
        raw, borders = utf8(column)
        self.raw, self.borders, self.rows = raw, borders, len(borders) - 1
        solid = np.zeros(len(raw) + 1, bool)
        np.logical_not(_SPACE[raw], out=solid[:-1])
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = solid[:-1]
        before[borders] = False  # a row's first byte follows nothing
        self.start = np.flatnonzero(solid & ~before)
        last = solid.copy()
        last[-1] = False
        after = np.zeros(len(raw) + 1, bool)
        after[:-1] = solid[1:]
        ends_of_rows = borders[1:] - 1
        after[ends_of_rows[ends_of_rows >= 0]] = False
        self.end = np.flatnonzero(last & ~after) + 1
        #: first[r]:first[r + 1] are the words of row r
        self.first = np.searchsorted(self.start, borders)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        #: the bytes that are hashed
        self.text = _LOWER[raw] if lower else raw
        self.hash = spans(self.text, self.start, self.end)


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span start:end."""
    if not len(start):
        return np.empty(0, _U)
    up, down = _powers(_BASE, len(raw)), _powers(_INVERSE, len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    # scaled down by the power at its start, so that a span's place doesn't matter
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


_made: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2**64; kept up to the longest batch so far."""
    if len(_made.get(int(base), ())) <= n:
        powers = np.full(n + 1, base, _U)
        powers[0] = 1
        _made[int(base)] = np.cumprod(powers, out=powers)
    return _made[int(base)][: n + 1]


def runs(words: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and each row's borders in them; short: a row of fewer words has all of them as one."""
    n, h, first = len(words.hash), words.hash, words.first
    count = np.diff(first)
    out = np.zeros(max(0, n - k + 1), _U)
    for i in range(k):
        out = mix(out + _U(2 * i + 1)) + h[i : n - k + 1 + i] if n >= k else out
    made = mix(out)
    keep = np.zeros(n, bool)
    if n >= k:
        keep[: n - k + 1] = words.row[: n - k + 1] == words.row[k - 1 :]
    sizes = np.maximum(count - k + 1, 0)
    made = made[keep[: len(made)]]
    if short and (few := np.flatnonzero((count > 0) & (count < k))).size:
        whole = np.zeros(len(few), _U)
        for i in range(k - 1):
            has = count[few] > i
            whole[has] = mix(whole[has] + _U(2 * i + 1)) + h[first[few][has] + i]
        whole = mix(whole ^ mix(count[few].astype(_U)))
        at = np.concatenate([[0], np.cumsum(sizes)])[few]
        made = np.insert(made, at, whole)
        sizes[few] = 1
    return made, np.concatenate([[0], np.cumsum(sizes)])


def distinct(values: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted, and the rows' new borders."""
    out = values.copy()
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    if len(out) > 1:
        fresh[1:] = out[1:] != out[:-1]
        starts = borders[:-1]
        fresh[starts[starts < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[borders]


#: Bytes that surely begin something other than white space.
_SURE = np.zeros(256, bool)
_SURE[[*range(33, 127), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_LONG = 64


def pieces(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts: each but a text's first begins at a space before a non-space."""
    flag = np.zeros(len(raw), bool)
    if len(raw):
        flag[:-1] = (raw[:-1] == 32) & _SURE[raw[1:]]
        ends = borders[1:] - 1
        flag[ends[ends >= 0]] = False
        begins = borders[:-1]
        flag[begins[begins < borders[1:]]] = True
    start = np.flatnonzero(flag)
    return start, np.append(start[1:], len(raw))[: len(start)]


def alike(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representatives, group of each): pieces grouped by their bytes; those over _LONG bytes stand alone.

    Groups come from hashes, and every piece is then compared with its
    representative, eight bytes at a time, so that unlike pieces never share one.
    """
    size = end - start
    key = spans(raw, start, end)
    long = np.flatnonzero(size > _LONG)
    key[long] = mix(long.astype(_U))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    words = _eights(raw)
    other = start[first][group]
    unlike = size != size[first][group]
    left = np.flatnonzero((size <= _LONG) & (other != start))
    for at in range(0, _LONG, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        cover = np.minimum(size[left] - at, 8).astype(_U)
        differ = (words[start[left] + at] ^ words[other[left] + at]) << ((_U(8) - cover) * _U(8))
        unlike[left[differ != 0]] = True
    odd = np.flatnonzero(unlike)
    if len(odd):
        group[odd] = len(first) + np.arange(len(odd))
        first = np.append(first, odd)
    return first, group


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one little-endian number."""
    padded = np.frombuffer(raw.tobytes() + bytes(16 - len(raw) % 8), "<u8")
    return np.lib.stride_tricks.as_strided(padded, (len(raw),), (1,))


class Recent:
    """Values by key, at most about keep of them: what wasn't used since half as many came is forgotten."""

    def __init__(self, keep: int):
        self.half, self.new, self.old = keep // 2, {}, {}

    def fill(self, keys: list, make) -> list:
        """The keys' values; make gives those of unknown keys, as a list."""
        found = list(map(self.new.get, keys))
        missing = []
        for i, x in enumerate(found):
            if x is None:
                x = self.old.get(keys[i])
                if x is None:
                    missing.append(i)
                else:
                    found[i] = self.new[keys[i]] = x
        if missing:
            fresh = [keys[i] for i in missing]
            for i, k, x in zip(missing, fresh, make(fresh), strict=True):
                found[i] = x
                if len(k) <= _LONG:
                    self.new[k] = x
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        return found


class PieceTable:
    """Ids of pieces of text, learnt as they come; learn gives the ids of new pieces as little-endian 32-bit integers."""

    def __init__(self, learn, keep: int = 600_000):
        self.learn, self.known = learn, Recent(keep)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column in a row, and each text's borders in them."""
        raw, borders = utf8(column)
        start, end = pieces(raw, borders)
        if not len(start):
            return np.empty(0, "<u4"), np.zeros(len(borders), np.int64)
        first, group = alike(raw, start, end)
        whole = raw.tobytes()
        kinds = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        found = self.known.fill(kinds, self.learn)
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        offset = np.cumsum(sizes) - sizes
        count = sizes[group]
        upto = np.append(0, np.cumsum(count))
        ids = flat[np.repeat(offset[group] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, borders)]


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, mixed: bool = False) -> np.ndarray:
    """A hash of each run start:end of 64-bit values, in order; mixed: the values have been scrambled before."""
    up, down = _powers(_BASE, len(values)), _powers(_INVERSE, len(values))
    total = np.zeros(len(values) + 1, _U)
    np.cumsum((values if mixed else mix(values)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
