"""Media columns in Ogg containers.

``streams`` reads a binary column of Ogg files: pages are found by their capture
pattern and kept only if their checksum is right, packets are reassembled from
the lacing values across pages, pages are parted by serial number into logical
streams, and times come from granule positions by the stream's codec (Opus:
48 kHz less the pre-skip; Vorbis, FLAC and Speex: the header's sampling rate).
A granule position is where the last packet that a page ends comes to its end:
``page_s`` lists these times, ``start_s`` is the first and ``end_s`` the last.

The page checksum is the CRC-32 of polynomial 0x04C11DB7 taken most significant
bit first. It is computed by zlib's CRC, which takes bits in the other order:
each byte's bits are reversed on the way in, and the result's on the way out.

A damaged page is skipped and the search goes on at the next capture pattern. A
gap in a stream's page numbers, or a continuation without its beginning, drops
the packet it interrupts and nothing else.

No table of the corpus holds media, so ``wrap`` makes a column of them from a
text column: the text's bytes are dealt in packets of changing sizes to an Opus
and a Vorbis stream, interleaved page by page. ``unwrap`` undoes it.

Cases. Null value: no rows. Empty value, or one without a good page: one row
with a null serial, which tells the bytes that were skipped. Very long values:
read whole. Header fields of any value: taken as they are. Chained streams that use a serial again: one stream each. Null
``doc_id`` and repeated rows: read like any other. Empty table: no rows. Extra
columns: ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm import frames

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """Ogg checksum of a page whose checksum field is zero."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


def pages(data: bytes) -> Iterator[Page | int]:
    """Good pages in order; a number stands for so many skipped bytes."""
    at, size, skipped = 0, len(data), 0
    while at < size:
        found = data.find(b"OggS", at)
        if found < 0 or found + 27 > size:
            skipped += size - at
            break
        skipped += found - at
        at = found
        _, version, flags, granule, serial, number, crc, segments = _HEADER.unpack_from(data, at)
        body = at + 27 + segments
        lacing = data[at + 27 : body]
        end = body + sum(lacing)
        if version == 0 and end <= size and len(lacing) == segments and checksum(b"%b\0\0\0\0%b" % (data[at : at + 22], data[at + 26 : end])) == crc:
            if skipped:
                yield skipped
                skipped = 0
            yield Page(flags, granule, serial, number, lacing, data[body:end])
            at = end
        else:
            skipped += 4
            at += 4
    if skipped:
        yield skipped


@dataclass
class Stream:
    """A logical stream, fed with its pages in order."""

    serial: int
    pages: int = 0
    lost_pages: int = 0
    dropped_packets: int = 0
    ended: bool = False
    first_granule: int | None = None
    last_granule: int | None = None
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    _next: int | None = None
    _part: list[bytes] | None = None

    def feed(self, page: Page) -> None:
        self.pages += 1
        gap = self._next is not None and page.number != self._next
        if gap:
            self.lost_pages += max(0, page.number - self._next)
        if self._part is not None and (gap or not page.flags & CONTINUED):
            self._part = None
            self.dropped_packets += 1
        orphan = bool(page.flags & CONTINUED) and self._part is None
        self._next = page.number + 1
        at, run, before = 0, 0, len(self.packets)
        for value in page.lacing:
            run += value
            if value == 255:
                continue
            piece = page.body[at : at + run]
            at, run = at + run, 0
            if orphan:
                orphan = False
                self.dropped_packets += 1
            elif self._part is not None:
                self._part.append(piece)
                self.packets.append(b"".join(self._part))
                self.granules.append(None)
                self._part = None
            else:
                self.packets.append(piece)
                self.granules.append(None)
        if page.lacing and page.lacing[-1] == 255 and not orphan:
            self._part = [*(self._part or []), page.body[at : at + run]]
        if page.granule >= 0 and len(self.packets) > before:
            self.granules[-1] = page.granule
            self.first_granule = page.granule if self.first_granule is None else self.first_granule
            self.last_granule = page.granule
        self.ended |= bool(page.flags & LAST)

    def header(self) -> tuple[str, int | None, int | None, int, int]:
        """Codec, channels, rate of the granule positions, pre-skip, header packets."""
        first = self.packets[0] if self.packets else b""
        if first[:8] == b"OpusHead" and len(first) >= 19:
            return "opus", first[9], 48_000, int.from_bytes(first[10:12], "little"), 2
        if first[:7] == b"\x01vorbis" and len(first) >= 16:
            return "vorbis", first[11], int.from_bytes(first[12:16], "little"), 0, 3
        if first[:5] == b"\x7fFLAC" and len(first) >= 31:
            bits = int.from_bytes(first[27:31], "big")
            return "flac", (bits >> 9 & 7) + 1, bits >> 12, 0, 1 + int.from_bytes(first[7:9], "big")
        if first[:8] == b"Speex   " and len(first) >= 52:
            return "speex", int.from_bytes(first[48:52], "little"), int.from_bytes(first[36:40], "little"), 0, 2
        return "unknown", None, None, 0, 0

    def seconds(self, granule: int | None) -> float | None:
        """Time of a granule position."""
        _, _, rate, skip, _ = self.header()
        return None if granule is None or not rate else max(0, granule - skip) / rate


def demultiplex(data: bytes) -> tuple[list[Stream], int]:
    """Logical streams in order of appearance, and how many bytes were skipped."""
    found, current, skipped = [], {}, 0
    for page in pages(data):
        if isinstance(page, int):
            skipped += page
            continue
        stream = current.get(page.serial)
        if stream is None or (page.flags & FIRST and stream.pages):
            stream = current[page.serial] = Stream(page.serial)
            found.append(stream)
        stream.feed(page)
    for stream in found:
        if stream._part is not None:  # the file ended within a packet
            stream._part = None
            stream.dropped_packets += 1
    return found, skipped


class Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int, room: int = 4096):
        self.serial, self.room, self.number = serial, room, 0
        self.lacing, self.body, self.size, self.continued, self.granule = bytearray(), [], 0, False, -1

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        at, left = 0, len(data)
        while True:
            if len(self.lacing) == 255 or self.size >= self.room:
                yield self.page(continues=at > 0)
            take = min(255, left)
            self.lacing.append(take)
            self.body.append(data[at : at + take])
            self.size += take
            at, left = at + take, left - take
            if take < 255:
                self.granule = granule
                return

    def page(self, flags: int = 0, continues: bool = False) -> bytes:
        flags |= CONTINUED * self.continued | FIRST * (self.number == 0)
        rest = bytes(self.lacing) + b"".join(self.body)
        head = _HEADER.pack(b"OggS", 0, flags, self.granule, self.serial, self.number, 0, len(self.lacing))
        crc = checksum(head + rest)
        self.number += 1
        self.lacing, self.body, self.size, self.continued, self.granule = bytearray(), [], 0, continues, -1
        return b"%b%b%b%b" % (head[:22], crc.to_bytes(4, "little"), head[26:], rest)


_SIZES = (400, 255, 37, 510, 1200, 1, 254, 765)


def mux(payload: bytes, serial: int = 1) -> bytes:
    """An Ogg file that carries the payload in turns in two streams."""
    opus, vorbis = Writer(serial & 0xFFFFFFFF), Writer((serial + 0x80000000) & 0xFFFFFFFF)
    out = []
    heads = (
        (opus, [b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 48_000, 0, 0), b"OpusTags" + bytes(8)]),
        (vorbis, [b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, 44_100, 0, 0, 0, 0xB8, 1), b"\x03vorbis" + bytes(9), b"\x05vorbis" + bytes(4)]),
    )
    for writer, packets in heads:
        out.extend(writer.packet(packets[0], 0))
        out.append(writer.page())
    for writer, packets in heads:
        for packet in packets[1:]:
            out.extend(writer.packet(packet, 0))
        out.append(writer.page())
    at, turn, clock = 0, 0, [312, 0]
    while at < len(payload):
        size = _SIZES[turn % len(_SIZES)]
        which = turn & 1
        clock[which] += (960, 1024)[which]
        out.extend((opus, vorbis)[which].packet(payload[at : at + size], clock[which]))
        at, turn = at + size, turn + 1
    for writer in (opus, vorbis):
        out.append(writer.page(LAST))
    return b"".join(out)


def unwrap(data: bytes) -> bytes:
    """The payload that ``mux`` was given."""
    by_codec = {s.header()[0]: s.packets[s.header()[4] :] for s in demultiplex(data)[0]}
    turns = [iter(by_codec["opus"]), iter(by_codec["vorbis"])]
    out, turn = [], 0
    while (packet := next(turns[turn & 1], None)) is not None:
        out.append(packet)
        turn += 1
    return b"".join(out)


def wrap(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: the texts as Ogg files; null for a null text."""

    @F.arrow_udf("binary")
    def media(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mux(t, zlib.crc32(t) & 0x7FFFFFFF) for t in column.cast(pa.binary()).to_pylist()], pa.binary())

    return frames.pick(docs, doc_id=id_col, text=text_col).select("doc_id", media("text").alias("media"))


_FIELDS = (
    ("serial", pa.int64()), ("codec", pa.string()), ("channels", pa.int64()), ("rate", pa.int64()), ("n_pages", pa.int64()), ("lost_pages", pa.int64()),
    ("n_packets", pa.int64()), ("dropped_packets", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()),
    ("start_s", pa.float64()), ("end_s", pa.float64()), ("page_s", pa.list_(pa.float64())), ("ended", pa.bool_()), ("skipped_bytes", pa.int64()),
)


def describe(data: bytes) -> list[tuple]:
    """A row for each logical stream."""
    found, skipped = demultiplex(data)
    out = []
    for s in found:
        codec, channels, rate, _, heads = s.header()
        payload = s.packets[heads:]
        times = [g for g in s.granules[heads:] if g is not None]
        clock = [s.seconds(g) for g in times]
        start, end = (clock[0], clock[-1]) if clock else (None, None)
        out.append((s.serial, codec, channels, rate, s.pages, s.lost_pages, len(payload), s.dropped_packets, sum(map(len, payload)), hashlib.sha1(b"".join(payload)).hexdigest(), start, end, clock, s.ended, skipped))
    return out or [(None,) * 14 + (skipped,)]


def streams(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``doc_id`` and the logical streams of each file of a binary column."""
    narrow = frames.pick(media, doc_id=id_col, media=media_col)

    def run(stream):
        for batch in frames.batches(stream):
            rows, found = [], []
            for k, value in enumerate(batch.column(1)):
                if value.is_valid:
                    own = describe(value.as_py())
                    rows.extend([k] * len(own))
                    found.extend(own)
            columns = [pa.array(list(x), kind) for x, (_, kind) in zip(zip(*found), _FIELDS)] if found else [pa.array([], kind) for _, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["doc_id", *(n for n, _ in _FIELDS)])

    kinds = "serial long, codec string, channels long, rate long, n_pages long, lost_pages long, n_packets long, dropped_packets long, payload_bytes long, payload_sha1 string, start_s double, end_s double, page_s array<double>, ended boolean, skipped_bytes long"
    return narrow.mapInArrow(run, f"doc_id {frames.ddl(narrow, 'doc_id')}, {kinds}")
