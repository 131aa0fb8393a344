"""Words of whole batches of texts as numpy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
#: What a byte's place in its word adds before mixing: the golden ratio as a 64-bit fraction, odd.
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def _byte_codes(fold_ascii: bool) -> np.ndarray:
    """A random 64-bit code for each byte; A-Z get those of a-z when folded."""
    codes = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_ascii:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


class Block:
    """Some texts in one buffer, and their words: `start`, `end` (byte places), `doc` (text number), `hash`.

    With `marks`, a word is also cut between an ASCII letter and one of these ASCII characters; with `width`, into
    pieces of that many bytes, of which the last may be shorter.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, fold_ascii: bool = False, marks: bytes = b"", width: int = 0):
        self.buf, self.offsets, self.n = buf, offsets, len(offsets) - 1
        inside = ~_SPACES[buf]
        begins, ends = inside.copy(), np.zeros(len(buf) + 1, dtype=bool)
        if len(buf):
            begins[1:] &= ~inside[:-1]
            ends[1:-1] = inside[:-1] & ~inside[1:]
            ends[-1] = inside[-1]
            edges = offsets[(offsets > 0) & (offsets < len(buf))]
            begins[edges] = inside[edges]
            ends[edges] |= inside[edges - 1]
            if marks:
                is_mark = np.zeros(256, dtype=bool)
                is_mark[list(marks)] = True
                at = np.flatnonzero(_LETTERS[buf[:-1]] & is_mark[buf[1:]]) + 1
                begins[at] = ends[at] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        if width and len(self.start) and int((self.end - self.start).max()) > width:
            long = np.flatnonzero(self.end - self.start > width)
            more = [np.arange(a + width, b, width) for a, b in zip(self.start[long].tolist(), self.end[long].tolist(), strict=True)]
            begins[np.concatenate(more)] = ends[np.concatenate(more)] = True
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        # each byte at each place in a word has a mixed value of its own, and a word's hash is that of their sum: no word's bytes are a polynomial in another's
        place = np.arange(len(buf), dtype=np.int64)
        if len(self.start):
            place -= self.start[np.maximum(np.cumsum(begins) - 1, 0)]
            value = mix(_CODES[fold_ascii][buf] + place.view(np.uint64) * _PLACE)
            value[~inside] = 0
            self.hash = mix(np.add.reduceat(value, self.start) + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.n)

    @property
    def first(self) -> np.ndarray:
        """Place of each text's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def characters(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `width` bytes of the words `at`, zero-padded, and their lengths (`width` at most)."""
        length = np.minimum(self.end[at] - self.start[at], width)
        places = self.start[at][:, None] + np.arange(width)[None, :]
        chars = self.buf[np.minimum(places, max(len(self.buf) - 1, 0))]
        chars[np.arange(width)[None, :] >= length[:, None]] = 0
        return chars, length


def blocks(column: pa.Array, fold_ascii: bool = False, marks: bytes = b"", width: int = 0) -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, block) over a binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
        last = min(last, n)
        yield row, last, Block(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], fold_ascii, marks, width)
        row = last


class KeyIndex:
    """Numbers of 64-bit keys in the order in which they were added: a long sorted list, and a short one that new keys are put into and that joins the long one when it is full."""

    SHORT = 1 << 16

    def __init__(self):
        self.count = 0
        self.lists = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)) for _ in range(2)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 for those not there."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for known, number in self.lists:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = number[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for sorted keys that are not there yet."""
        numbers = np.arange(self.count, self.count + len(keys))
        self.count += len(keys)
        long, (known, number) = self.lists
        at = np.searchsorted(known, keys)
        short = np.insert(known, at, keys), np.insert(number, at, numbers)
        if len(short[0]) > self.SHORT:
            both = np.concatenate([long[0], short[0]])
            order = np.argsort(both, kind="stable")
            long, short = (both[order], np.concatenate([long[1], short[1]])[order]), (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        self.lists = [long, short]
        return numbers


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a longer one with its first `used` entries, with room for `more`."""
    if used + more <= len(array):
        return array
    out = np.zeros((max(used + more, len(array) * 3 // 2), *array.shape[1:]), dtype=array.dtype)
    out[:used] = array[:used]
    return out


class TypeTable:
    """Values of word types by hash, kept over the batches of a worker; at `limit` types it starts anew."""

    def __init__(self, width: int, limit: int = 1_500_000, dtype=np.float32):
        self.limit, self.width, self.dtype = limit, width, dtype
        self.clear()

    def clear(self) -> None:
        self.index, self.values = KeyIndex(), np.zeros((1 << 12, self.width), dtype=self.dtype)

    def of(self, hashes: np.ndarray, make) -> np.ndarray:
        """Values of the hashes; make(places) gives those of the types not seen yet, by a place of each."""
        types, place, back = np.unique(hashes, return_index=True, return_inverse=True)
        number = self.index.find(types)
        known = number >= 0
        out = np.empty((len(types), self.width), dtype=self.dtype)
        out[known] = self.values[number[known]]
        if not known.all():
            out[~known] = made = make(place[~known])
            if self.index.count + len(made) > self.limit:
                self.clear()
            self.values = _room(self.values, self.index.count, len(made))
            self.values[self.index.add(types[~known])] = made
        return out[back]


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of a pool, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - length), length) + np.arange(total)]


class RaggedTable:
    """Sequences (one for each field) of word types by hash, kept over the batches of a worker in pools; at `limit` types it starts anew.

    A type may have no sequence (None): its length is -1 in every field.
    """

    def __init__(self, dtypes: tuple, limit: int = 2_500_000):
        self.dtypes, self.limit = dtypes, limit
        self.clear()

    def clear(self) -> None:
        self.index = KeyIndex()
        self.place = [np.zeros(1 << 12, dtype=np.int64) for _ in self.dtypes]
        self.length = [np.zeros(1 << 12, dtype=np.int32) for _ in self.dtypes]
        self.pool = [np.zeros(1 << 16, dtype=d) for d in self.dtypes]
        self.used = [0] * len(self.dtypes)

    def _append(self, field: int, made: list) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([-1 if m is None else len(m) for m in made], dtype=np.int32)
        flat = np.concatenate([np.frombuffer(m, dtype=self.dtypes[field]) if isinstance(m, bytes) else np.asarray(m, dtype=self.dtypes[field]) for m in made if m is not None] or [np.zeros(0, dtype=self.dtypes[field])])
        used, size = self.used[field], np.maximum(length, 0).astype(np.int64)
        self.pool[field] = _room(self.pool[field], used, len(flat))
        self.pool[field][used : used + len(flat)] = flat
        self.used[field] = used + len(flat)
        return used + np.cumsum(size) - size, length

    def of(self, hashes: np.ndarray, make) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place, length) in the pool of each field for every hash; make(places) gives the fields' lists for new types, by a place of each."""
        types, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        number = self.index.find(types)
        if self.index.count + int((number < 0).sum()) > self.limit:
            self.clear()
            number[:] = -1
        new = np.flatnonzero(number < 0)
        if len(new):
            made = make(where[new])
            count = self.index.count
            number[new] = numbers = self.index.add(types[new])
            for field, lists in enumerate(made):
                place, length = self._append(field, lists)
                self.place[field], self.length[field] = _room(self.place[field], count, len(new)), _room(self.length[field], count, len(new))
                self.place[field][numbers], self.length[field][numbers] = place, length
        return [(p[number][back], n[number][back]) for p, n in zip(self.place, self.length, strict=True)]
