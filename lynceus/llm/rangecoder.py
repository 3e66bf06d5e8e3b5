"""Token ids as binary: an adaptive context-mixing range coder.

Ids are coded in blocks of at most ``BLOCK`` ids. Every block starts with a fresh
model and carries its own checksum, so any block is decoded, and checked,
without the others. The probability of the next id mixes predictions of three
orders:

* order 0: how often each id has come in the block, on top of a prior that falls
  with the id (vocabularies list frequent entries first);
* order 1: the id that last followed the previous id, and the last other one;
* order 2: the same after the previous two ids.

Each of these four candidates has a state (for how long it has come in a row,
how much came before, whether the orders agree), and its weight in the mixture
is how often candidates in that state have been right so far in the block,
brought up to date every ``CHUNK`` ids. One range-coder step codes an id. All
numbers are integers, and the decoder repeats the encoder's steps exactly.

The encoder has all ids at hand, so it finds every prediction of many blocks at
once by sorting (``_model``), and only the coder's arithmetic goes id by id, as
numpy vectors over the blocks. The decoder is a plain loop over the ids of a
block with dictionaries, written without the encoder's parts. The coder has a
60-bit low and puts out digits of 12 bits; a carry is added to the last digit,
and carries are resolved when a block ends.

A block's bytes: magic, number of ids, number of digits, CRC-32 of the ids (as
little-endian 32-bit numbers), bits of the largest id, then the digits, two to
three bytes.

Cases. Null text or null ids: no tokens. A null within an array of ids: not an
id, left out. Empty text: no tokens, and the document is listed with length 0.
Very long text: goes on through as many blocks as it needs. Null ``doc_id`` and
repeated rows: coded like any other. Empty table: no rows. Extra columns:
ignored. Ids must be in 0..2**24-1; others raise.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm import frames, textkernel, tokens

BLOCK = 4096
CHUNK = 128
LANES = 2048
MAX_IDS = 1 << 24

_MAGIC = b"TKB2"
_HEAD = struct.Struct("<4sIIIB")
_TOP, _FULL, _DIGIT = 48, (1 << 60) - 1, 12
_WEIGHT, _LEFT = 1 << 14, 64  # of all predictions, and what order 0 keeps at least
_STATES = 24
_MODELLED = 32  # blocks at a time
_CHUNKS = BLOCK // CHUNK
_SIDE = 64


class CorruptBlock(ValueError):
    """A block whose bytes don't give the ids that its checksum was made of."""


def _bits(largest: int) -> int:
    return max(8, largest.bit_length())


def _prior_total(bits):
    return (bits - 8) * (2 << bits) + 512


def _context(one, two):
    """The order-2 context as a number of 40 bits; what shares one shares its candidates."""
    return (one * 0x9E3779B1 + two * 0x85EBCA77) & ((1 << 40) - 1)


# -- encoder --


def _below(rank: np.ndarray) -> np.ndarray:
    """For each place of each row (a permutation), how many smaller ranks stand before it."""

    def pairs(x: np.ndarray) -> np.ndarray:
        """The same within runs of ``_SIDE`` along the last axis."""
        turned = np.ascontiguousarray(x.reshape(-1, _SIDE).T)
        count = np.zeros(turned.shape, np.uint8)
        for k in range(1, _SIDE):
            count[k:] += turned[k:] > turned[:-k]
        return count.T.reshape(x.shape)

    lanes, n = rank.shape
    sides = n // _SIDE
    chunk, bucket = np.arange(n)[None, :] // _SIDE, rank // _SIDE
    at = ((np.arange(lanes)[:, None] * sides + chunk) * sides + bucket).ravel()
    table = np.bincount(at, minlength=lanes * sides * sides).reshape(lanes, sides, sides).astype(np.int16)
    table = table.cumsum(axis=1, dtype=np.int16) - table
    table = table.cumsum(axis=2, dtype=np.int16) - table
    out = pairs(rank.astype(np.int16)) + table.ravel()[at].reshape(lanes, n)  # in the own run, and in earlier ones by bucket
    place = np.empty((lanes, n), np.int16)
    np.put_along_axis(place, rank, np.broadcast_to(np.arange(n, dtype=np.int16), rank.shape), axis=1)
    return out + np.take_along_axis(pairs((place // _SIDE).astype(np.int8)), rank, axis=1)


def _order0(x: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulated and own frequency of each id among the ids before it, with the prior."""
    lanes, n = x.shape
    row, step = np.arange(lanes)[:, None], np.arange(n)[None, :]
    ranked = np.sort((x << 12) | step, axis=1)
    place, ids = ranked & 4095, ranked >> 12
    fresh = np.ones((lanes, n), bool)
    fresh[:, 1:] = ids[:, 1:] != ids[:, :-1]
    flat = (place + row * n).ravel()
    same, rank = np.empty(lanes * n, np.int64), np.empty(lanes * n, np.int64)
    same[flat] = (step - np.maximum.accumulate(np.where(fresh, step, 0), axis=1)).ravel()
    rank[flat] = np.broadcast_to(step, x.shape).ravel()
    same = same.reshape(lanes, n)
    less = _below(rank.reshape(lanes, n)) - same
    v = x + 256
    octave = np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1
    down = bits[:, None] + 1 - octave
    gain = (_prior_total(bits) >> 9)[:, None]
    return ((octave - 8) << (bits[:, None] + 1)) + ((v - (1 << octave)) << down) + gain * less, (1 << down) + gain * same


def _candidates(x: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last id in the context, the last other one (-1: none), and their state."""
    lanes, n = x.shape
    ranked = np.sort((context << 12) | np.arange(n)[None, :], axis=1)
    flat = ((ranked & 4095) + np.arange(lanes)[:, None] * n).ravel()
    y, context = x.ravel().take(flat), (ranked >> 12).ravel()
    j = np.arange(lanes * n, dtype=np.int32)
    head = np.ones(lanes * n, bool)
    np.not_equal(context[1:], context[:-1], out=head[1:])
    head[::n] = True
    turn = head.copy()
    turn[1:] |= y[1:] != y[:-1]
    start, run = np.maximum.accumulate(j * head), np.maximum.accumulate(j * turn)
    before = run[:-1]  # where the run that ends just before each place began
    earlier = before - start[1:]
    state = np.minimum(j[:-1] - before, 3) + ((earlier > 0).view(np.int8) + (earlier > 2).view(np.int8)) * np.int8(4)
    first, second = np.full(lanes * n, -1, np.int32), np.full(lanes * n, -1, np.int32)
    states = np.zeros(lanes * n, np.int32)
    there = ~head[1:]
    behind = flat[1:]
    first[behind] = np.where(there, y[:-1], -1)
    second[behind] = np.where((earlier > 0) & there, y.take(before - 1), -1)
    states[behind] = state
    return first.reshape(lanes, n), second.reshape(lanes, n), states.reshape(lanes, n)


def _model(x: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative frequency and frequency of every id, in a total of ``_WEIGHT`` times that of order 0."""
    lanes, n = x.shape
    back = np.zeros((lanes, n + 2), np.int64)
    back[:, 2:] = x
    one, two = back[:, 1:-1], back[:, :-2]
    narrow = x.astype(np.int32)
    a, b, deep = _candidates(narrow, _context(one, two))
    c, d, flat = _candidates(narrow, one)
    agree = (c == a) & (a >= 0)
    c[(c == a) | (c == b)] = -1
    d[(d == a) | (d == b)] = -1
    slot = ((np.arange(lanes)[:, None] * _CHUNKS + np.arange(n)[None, :] // CHUNK) * _STATES).astype(np.int32)
    rest, open_ = np.full(x.shape, _WEIGHT, np.int64), np.ones(x.shape, bool)
    below, equal = np.zeros(x.shape, np.int64), np.zeros(x.shape, np.int64)
    for guess, state in ((a, deep + agree * np.int32(12)), (b, deep), (c, flat), (d, flat)):
        there, right = guess >= 0, guess == narrow
        key = slot + state
        counts = np.bincount((key * np.int32(2) + right)[there & open_], minlength=lanes * _CHUNKS * _STATES * 2).reshape(lanes, _CHUNKS, _STATES, 2)
        counts = counts.cumsum(axis=1) - counts
        tried, hit = counts.sum(axis=3), counts[..., 1]
        weight = (rest - _LEFT) * ((5 * hit + 2) * 65535 // (5 * tried + 6)).ravel().take(key) >> 16
        weight *= there
        rest -= weight
        below += weight * (guess < narrow)
        equal += weight * right
        open_ &= ~right
    at, own = _order0(x, bits)
    total = (_prior_total(bits)[:, None] + (_prior_total(bits) >> 9)[:, None] * np.arange(n)[None, :])
    return rest * at + below * total, rest * own + equal * total


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of each block of ids."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    out: list[bytes] = [b""] * len(blocks)
    groups = -(-len(order) // LANES)
    for g in range(groups):
        some = order[len(order) * g // groups : len(order) * (g + 1) // groups]
        for k, data in zip(some, _encode([blocks[k] for k in some])):
            out[k] = data
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lanes, sizes = len(blocks), np.array([len(b) for b in blocks])
    steps = int(sizes[0]) if lanes else 0
    if steps > BLOCK:
        raise ValueError(f"a block has at most {BLOCK} ids")
    for b in blocks:
        if len(b) and not 0 <= int(b.min()) <= int(b.max()) < MAX_IDS:
            raise ValueError(f"ids must be in 0..{MAX_IDS - 1}")
    bits = np.array([_bits(int(b.max(initial=0))) for b in blocks], np.int64)
    ats, owns = np.empty((steps, lanes), np.uint64), np.empty((steps, lanes), np.uint64)
    for start in range(0, lanes, _MODELLED):
        some = slice(start, min(start + _MODELLED, lanes))
        n = -(-int(sizes[start]) // _SIDE) * _SIDE  # what is padded comes after all that counts
        if not n:
            break
        x = np.zeros((some.stop - start, n), np.int64)
        for k, b in enumerate(blocks[some]):
            x[k, : len(b)] = b
        at, own = _model(x, bits[some])
        ats[:n, some], owns[:n, some] = at.T[:steps], own.T[:steps]
    base, gain = (_WEIGHT * _prior_total(bits)).astype(np.uint64), (_WEIGHT * (_prior_total(bits) >> 9)).astype(np.uint64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
    spot = np.arange(lanes)  # of the next digit: its number times the lanes, and the lane
    spots, digits, carries = [], [], []
    top, twelve, rest, full = np.uint64(_TOP), np.uint64(_DIGIT), np.uint64((1 << _TOP) - 1), np.uint64(_FULL)
    live = lanes
    for step in range(steps):
        if sizes[live - 1] <= step:
            live = int(np.searchsorted(-sizes, -step))
            low_, span_, base_, gain_ = low[:live], span[:live], base[:live], gain[:live]
        elif not step:
            low_, span_, base_, gain_ = low, span, base, gain
        unit = span_ // base_
        base_ += gain_
        low_ += unit * ats[step, :live]
        np.multiply(unit, owns[step, :live], out=span_)
        over = low_ > full
        if over.any():
            carry = over.nonzero()[0]
            carries.append(spot.take(carry) - lanes)
            low[carry] &= full
        short = (span_ <= rest).nonzero()[0]
        while len(short):
            l, p, s = low.take(short), spot.take(short), span.take(short) << twelve
            spots.append(p)
            digits.append((l >> top).astype(np.uint16))
            spot[short] = p + lanes
            low[short] = (l & rest) << twelve
            span[short] = s
            short = short[s <= rest]
    for k in range(5):
        spots.append(spot + k * lanes)
        digits.append(((low >> np.uint64(_TOP - _DIGIT * k)) & np.uint64(4095)).astype(np.uint16))
    place = spot // max(lanes, 1) + 5
    table = np.zeros((int(place.max(initial=0)) + 1, lanes), np.uint16)
    table.ravel()[np.concatenate(spots)] = np.concatenate(digits)
    if carries:
        np.add.at(table.ravel(), np.concatenate(carries), np.uint16(1))
    for k in range(len(table) - 1, 0, -1):
        over = table[k] >> _DIGIT
        if over.any():
            table[k] &= 4095
            table[k - 1] += over
    digits = np.ascontiguousarray(table.T)
    out = []
    for k, b in enumerate(blocks):
        n = int(place[k])
        own = np.zeros(n + n % 2, np.int32)
        own[:n] = digits[k, :n]
        pair = own[0::2] << 12 | own[1::2]
        packed = np.stack([pair >> 16, pair >> 8 & 255, pair & 255], axis=1).astype(np.uint8).tobytes()
        out.append(_HEAD.pack(_MAGIC, len(b), n, zlib.crc32(np.asarray(b, "<u4").tobytes()), int(bits[k])) + packed)
    return out


# -- decoder --


class _Seen:
    """Order 0: the ids so far, sorted, and the prior."""

    def __init__(self, bits: int):
        self.bits, self.ids = bits, []
        self.base = _prior_total(bits)
        self.gain = self.base >> 9

    def total(self) -> int:
        return self.base + self.gain * len(self.ids)

    def prior(self, x: int) -> tuple[int, int]:
        octave = (x + 256).bit_length() - 1
        down = self.bits + 1 - octave
        return ((octave - 8) << (self.bits + 1)) + ((x + 256 - (1 << octave)) << down), 1 << down

    def share(self, x: int) -> tuple[int, int]:
        at, own = self.prior(x)
        less = bisect.bisect_left(self.ids, x)
        return at + self.gain * less, own + self.gain * (bisect.bisect_right(self.ids, x, less) - less)

    def find(self, target: int) -> int:
        """The id whose share holds the target."""
        low, high = 0, len(self.ids)  # how many of the ids begin at or before it
        while low < high:
            middle = (low + high) // 2
            if self.prior(self.ids[middle])[0] + self.gain * middle <= target:
                low = middle + 1
            else:
                high = middle
        if low:
            x = self.ids[low - 1]
            at, own = self.prior(x)
            if target < at + self.gain * low + own:
                return x
        target -= self.gain * low
        octave = 8 + (target >> (self.bits + 1))
        return min((1 << octave) + ((target & ((2 << self.bits) - 1)) >> (self.bits + 1 - octave)) - 256, (1 << self.bits) - 1)

    def add(self, x: int) -> None:
        bisect.insort(self.ids, x)


class _Followers:
    """Candidates of one order: for each context the last id, the last other one, its run, and what came before."""

    def __init__(self):
        self.known: dict[int, tuple[int, int, int, int]] = {}

    def of(self, context: int) -> tuple[int, int, int]:
        first, second, run, before = self.known.get(context, (-1, -1, 0, 0))
        return first, second, min(run - 1, 3) + 4 * ((before > 0) + (before > 2)) if run else 0

    def add(self, context: int, x: int) -> None:
        first, second, run, before = self.known.get(context, (-1, -1, 0, 0))
        self.known[context] = (x, second, run + 1, before) if x == first else (x, first, 1, before + run)


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ``CorruptBlock``."""
    return [_decode(data) for data in blocks]


def _decode(data: bytes) -> np.ndarray:
    if len(data) < _HEAD.size or data[:4] != _MAGIC:
        raise CorruptBlock("no block begins here")
    _, size, n, crc, bits = _HEAD.unpack_from(data)
    if len(data) != _HEAD.size + (n + 1) // 2 * 3:
        raise CorruptBlock("the block is cut off")
    if size > BLOCK or not 8 <= bits <= 24 or n < 5:
        raise CorruptBlock("the header is wrong")
    packed = np.frombuffer(data, np.uint8, offset=_HEAD.size).reshape(-1, 3).astype(np.int64)
    pair = packed[:, 0] << 16 | packed[:, 1] << 8 | packed[:, 2]
    digits = np.stack([pair >> 12, pair & 4095], axis=1).ravel().tolist()[:n]
    code = 0
    for digit in digits[:5]:
        code = code << 12 | digit
    place, span, ids = 5, _FULL, []
    seen, pairs, singles = _Seen(bits), _Followers(), _Followers()
    tried, hit = [[[0] * _STATES for _ in range(4)] for _ in range(2)]
    chance: list[list[int]] = []
    one = two = 0
    for step in range(size):
        if step % CHUNK == 0:
            chance = [[(5 * h + 2) * 65535 // (5 * t + 6) for t, h in zip(*x)] for x in zip(tried, hit)]
        context = _context(one, two)
        a, b, deep = pairs.of(context)
        c, d, flat = singles.of(one)
        agree = c == a and a >= 0
        if c in (a, b):
            c = -1
        if d in (a, b):
            d = -1
        order = ((a, deep + 12 * agree), (b, deep), (c, flat), (d, flat))
        rest, weights = _WEIGHT, []
        for k, (guess, state) in enumerate(order):
            if guess >= 0:
                weight = (rest - _LEFT) * chance[k][state] >> 16
                rest -= weight
                weights.append((guess, weight))
        whole = seen.total()
        unit = span // (_WEIGHT * whole)
        value = min(code // unit, _WEIGHT * whole - 1)
        passed, x = 0, -1
        for guess, weight in sorted(weights):
            at, own = seen.share(guess)
            at = rest * at + passed * whole
            if value < at:
                break
            if value < at + rest * own + weight * whole:
                x = guess
                break
            passed += weight
        if x < 0:
            x = seen.find(min((value - passed * whole) // rest, whole - 1))
        at, own = seen.share(x)
        code -= unit * (rest * at + sum(w for g, w in weights if g < x) * whole)
        span = unit * (rest * own + sum(w for g, w in weights if g == x) * whole)
        while span < 1 << _TOP:
            code = code << 12 | (digits[place] if place < n else 0)
            place += 1
            span <<= 12
        for k, (guess, state) in enumerate(order):
            if guess >= 0:
                tried[k][state] += 1
                if guess == x:
                    hit[k][state] += 1
                    break
        seen.add(x)
        pairs.add(context, x)
        singles.add(one, x)
        one, two = x, one
        ids.append(x)
    out = np.array(ids, np.int32)
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise CorruptBlock("the checksum is wrong")
    return out


# -- tables --


class _Blocks:
    """Rows of a partition, numbered in the order in which they are made."""

    def __init__(self, part: int):
        self.part, self.block, self.doc = part, 0, 0

    def rows(self, doc_ids: pa.Array, flat: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Blocks of a batch's ids, with the documents that each holds, and how many ids of each from which on."""
        cuts = np.arange(0, max(len(flat), 1), BLOCK)
        ends = np.minimum(cuts + BLOCK, len(flat))
        data = encode([flat[a:b] for a, b in zip(cuts, ends)])
        # a document is in the blocks from that of its first id to that of its last
        first = np.minimum(at[:-1] // BLOCK, len(cuts) - 1)
        last = np.maximum(first, (at[1:] - 1) // BLOCK)
        copies = last - first + 1
        doc = np.repeat(np.arange(len(copies)), copies)
        block = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(first, copies)
        begin = np.maximum(at[doc], cuts[block])
        inside = np.maximum(np.minimum(at[doc + 1], ends[block]) - begin, 0)
        edges = np.searchsorted(block, np.arange(len(cuts) + 1))
        bounds = pa.array(edges, pa.int32())
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(cuts), self.part), pa.int32()),
                pa.array(self.block + np.arange(len(cuts)), pa.int64()),
                pa.array(self.doc + doc[edges[:-1]], pa.int64()),
                pa.ListArray.from_arrays(bounds, doc_ids.take(pa.array(doc))),
                pa.ListArray.from_arrays(bounds, pa.array(np.minimum(begin, at[doc + 1]) - at[doc], pa.int64())),
                pa.ListArray.from_arrays(bounds, pa.array(inside, pa.int32())),
                pa.array(ends - cuts, pa.int32()),
                pa.array(data, pa.binary()),
            ],
            names=["part", "block_number", "first_document", "doc_ids", "doc_offsets", "doc_tokens", "n_tokens", "block"],
        )
        self.block += len(cuts)
        self.doc += len(copies)
        return out


def _schema(kind: str) -> str:
    return f"part int, block_number long, first_document long, doc_ids array<{kind}>, doc_offsets array<long>, doc_tokens array<int>, n_tokens int, block binary"


def write(docs: DataFrame, *, vocabulary: str = tokens.VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Coded ids of all texts, a row for each block.

    ``part, block_number`` is the block's place; ``first_document`` is the number
    within ``part`` of the first document of ``doc_ids``, the others follow it.
    A document's ids are ``doc_tokens`` ids of the block, from ``doc_offsets`` of
    the document on; one that goes on in the next block is listed in both, under
    the same number. So ``read`` needs no order of the rows.
    """
    narrow = frames.pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tokens.Automaton.of(tokens.read_vocabulary(vocabulary)))  # as large as the vocabulary

    def run(stream):
        blocks = _Blocks(TaskContext.get().partitionId())
        for batch in frames.batches(stream):
            yield blocks.rows(batch.column(0), *shared.value.encode_texts(batch.column(1)))

    return narrow.mapInArrow(run, _schema(frames.ddl(narrow, "doc_id")))


def write_ids(rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The same for a column ``array<int>`` of ids."""
    narrow = frames.pick(rows, doc_id=id_col, ids=ids_col)

    def run(stream):
        blocks = _Blocks(TaskContext.get().partitionId())
        for batch in frames.batches(stream):
            column = textkernel.as_array(batch.column(1))
            flat = column.flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            size = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(size)])]
            yield blocks.rows(batch.column(0), flat.drop_null().to_numpy(zero_copy_only=False), at)

    return narrow.mapInArrow(run, _schema(frames.ddl(narrow, "doc_id")))


def read(blocks: DataFrame) -> DataFrame:
    """``doc_id, ids`` of every document that was written, from its blocks in any order."""
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(stream):
        for batch in frames.batches(stream):
            for row in batch.select(["part", "first_document", "doc_ids", "doc_offsets", "doc_tokens", "block"]).to_pylist():
                ids, at = _decode(row["block"]), np.concatenate([[0], np.cumsum(row["doc_tokens"])])
                n = len(row["doc_ids"])
                own = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                place = [pa.array([row["part"]] * n, pa.int32()), pa.array(row["first_document"] + np.arange(n), pa.int64()), pa.array(row["doc_offsets"], pa.int64())]
                yield pa.RecordBatch.from_arrays([*place, pa.array(row["doc_ids"], batch.column("doc_ids").type.value_type), own], names=["part", "document", "start", "doc_id", "ids"])

    pieces = blocks.mapInArrow(run, f"part int, document long, start long, doc_id {kind}, ids array<int>")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])
    return pieces.groupBy("part", "document").agg(F.first("doc_id").alias("doc_id"), F.flatten(ordered).alias("ids")).select("doc_id", "ids")
