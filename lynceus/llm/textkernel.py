"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw UTF-8 buffers of an Arrow string column, so a
batch of documents is scanned by numpy without creating one Python object per
row. Texts are cut into sub-batches of about ``SLICE_BYTES`` so that scratch
arrays stay small whatever the length of the documents; a sub-batch always
holds whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

#: Letters, digits and every byte of a multi-byte UTF-8 sequence make words.
WORD_BYTE = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTE[_lo:_hi] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        grown = []
        for base in (_MULT, _INVERSE):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        _powers = (grown[0], grown[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def as_array(column) -> pa.Array:
    """An Arrow string array, whatever chunking or width the column came with."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column


def slices(column, lower: bool = True, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, bytes, offsets)`` for runs of whole documents.

    A null text comes out as an empty one. ``offsets`` has one entry more than
    the run has rows and starts at zero.
    """
    column = as_array(column)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) and column.buffers()[1] is not None else np.zeros(len(column) + 1, np.int64)
    row, n = 0, len(column)
    while row < n:
        stop = int(np.searchsorted(offsets, int(offsets[row]) + size, "right")) - 1
        stop = min(n, max(stop, row + 1))
        part = column.slice(row, stop - row)
        if lower:
            part = pc.utf8_lower(part)
        view = np.frombuffer(part.buffers()[1], np.int64 if wide else np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = part.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[view[0] : view[-1]] if data is not None else np.zeros(0, np.uint8)
        yield row, raw, view - view[0]
        row = stop


def classes(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[raw]`` for a table of 256 one-byte entries."""
    return np.frombuffer(raw.tobytes().translate(table.tobytes()), table.dtype)


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a document boundary.

    Returns starts, ends, and for each document the index of its first run
    (one entry more than there are documents).
    """
    n = len(flag)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    begin = flag.copy()
    begin[1:] &= ~flag[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    begin[inner] = flag[inner]
    finish = flag.copy()
    finish[:-1] &= ~flag[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finish[last] = flag[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` reads any span off them."""
    up, _ = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, independent of where it lies.

    It tells the words of a text apart for statistics. Texts can be made in which
    different long words have one hash, so what must be exact uses ``distinct``.
    """
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, 64-bit hashes, and the first word of each document."""
    starts, ends, first = runs(classes(raw, WORD_BYTE), offsets)
    return starts, ends, span_hash(prefix_hash(raw), starts, ends), first


_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_LONGEST = 64


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each content, and for every span the number of its content.

    Spans that are told equal are equal byte by byte. Up to seven bytes are
    their own key; up to ``_LONGEST`` are found by a hash and then compared;
    longer ones are rare and stand for themselves, as do those that differ from
    another one with the same hash.
    """
    length = ends - starts
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place on
    keys = eight[starts] & _LOW[np.minimum(length, 8)]
    middle, long = np.flatnonzero((length > 7) & (length <= _LONGEST)), np.flatnonzero(length > _LONGEST)
    words: list[np.ndarray] = []  # of the spans of ``middle``, zero behind their ends
    for k in range(_LONGEST // 8):
        left = length[middle] - 8 * k
        if not len(left) or left.max() <= 0:
            break
        some = left > 0
        word = np.zeros(len(middle), np.uint64)
        word[some] = eight[starts[middle[some]] + 8 * k] & _LOW[np.minimum(left[some], 8)]
        words.append(word)
    keys |= np.minimum(length, 8).astype(np.uint64) << np.uint64(56)
    h = length[middle].astype(np.uint64)
    for word in words:
        h = mix(h ^ word)
    keys[middle] = h | np.uint64(1 << 63)
    short = np.flatnonzero(length <= _LONGEST)
    coded = pc.dictionary_encode(pa.array(keys[short]))
    code, kinds = coded.indices.to_numpy(), len(coded.dictionary)
    which = np.empty(len(starts), np.int64)
    which[short] = code
    first = np.empty(kinds, np.int64)
    first[code[::-1]] = short[::-1]
    place = np.full(len(starts), -1, np.int64)
    place[middle] = np.arange(len(middle))
    other = place[first[which[middle]]]
    differ = length[middle] != length[middle[other]]
    for word in words:
        differ |= word != word[other]
    alone = np.concatenate([middle[differ], long])
    which[alone] = kinds + np.arange(len(alone))
    return np.concatenate([first, alone]), which


def hash_words(texts: list[str]) -> np.ndarray:
    """The hash that ``words`` gives to each of these lower-case words."""
    out = np.empty(len(texts), np.uint64)
    for i, word in enumerate(texts):
        raw = np.frombuffer(word.encode(), np.uint8)
        out[i] = span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0]
    return out
