"""Benchmark decontamination with Wu-Manber multi-pattern search.

Texts and benchmark items are lower-cased and every run of bytes that are not
letters or digits becomes one space. The test strings are all windows of
``window`` consecutive words of an item (the whole item where it is shorter),
so a document that quotes part of an item is found too. Items of under
``least_words`` words are not searched: everyday texts hold "Paris" without
quoting a benchmark.

Search follows Wu and Manber: ``m`` is the length of the shortest test string,
and only the first ``m`` bytes of each take part. The shift table, indexed by a
hash of the last ``BLOCK`` bytes read, says how far the window may move without
missing a string; a shift of zero leads to the bucket of strings whose first
``m`` bytes end in that block. A string's first bytes are compared, then all of
it. Many stretches of text are scanned at once, each with its own position, as
one numpy vector. Strings of under ``SHORT`` bytes get tables of their own, so
that they don't shorten the shifts of the others.

The test strings are broadcast with the task. That set depends on the
benchmark and not on the corpus. Its size is counted first, on the executors:
up to ``PATTERNS_PER_PASS`` windows there is one pass, and a larger benchmark is
parted by a hash of the item's id into passes that each collect, broadcast and
search their own part, so no string is left out, and what the driver and a task
hold stays bounded. (One item is never parted.) ``remove`` writes the rows that
are left between passes, so that a task holds the tables of one.

Cases. Null, empty or wordless text or item, and an item that is too short:
nothing is found. Very long text:
searched whole. An item repeated under several ids: each id is reported.
Repeated documents: each row is reported. Null ``doc_id`` or ``item_id``:
carried through. Empty tables: no rows. Extra columns: ignored by ``matches``,
kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lynceus.llm import frames, textkernel

WINDOW = 13
LEAST_WORDS = 5
BLOCK = 8
SHORT = 24
PATTERNS_PER_PASS = 200_000
_HASH_BITS = 20
_STRETCH = 256


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of ``" word word "`` for each document.

    Documents are whole in the result and adjoin with two spaces, which no
    test string contains.
    """
    word = textkernel.classes(raw, textkernel.WORD_BYTE)
    starts, ends, first = textkernel.runs(word, offsets)
    size = np.diff(first)
    if not len(starts):
        return np.full(len(size), 32, np.uint8), np.arange(len(size) + 1)
    length = ends - starts
    doc = np.repeat(np.arange(len(size)), size)
    # each word is followed by a space, each document begins with one
    place = np.cumsum(length + 1) - (length + 1) + doc + 1
    out = np.full(int(length.sum()) + len(starts) + len(size), 32, np.uint8)
    kept = np.flatnonzero(word)
    out[kept - np.repeat(starts - place, length)] = raw[kept]
    ends_at = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=length + 1, minlength=len(size)).astype(np.int64) + 1)])
    return out, ends_at


def strings(items: list[tuple[object, str | None]], window: int = WINDOW, least_words: int = LEAST_WORDS) -> dict[bytes, list]:
    """Test string -> ids of the items that hold it."""
    found: dict[bytes, dict] = {}
    texts = pa.array([t for _, t in items], pa.string())
    for row, raw, offsets in textkernel.slices(texts):
        clean, at = normalise(raw, offsets)
        for k in range(len(at) - 1):
            words = clean[at[k] : at[k + 1]].tobytes().split()
            for i in range(max(1, len(words) - window + 1) if len(words) >= max(1, least_words) else 0):
                found.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", {})[items[row + k][0]] = None
    return {piece: [*ids] for piece, ids in found.items()}


class WuManber:
    """Shift table, suffix buckets and strings of one set of patterns."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        self.shift = np.full(1 << _HASH_BITS, self.m - self.block + 1, np.int32)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        for j in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._hash([heads[:, j - k] for k in range(self.block)]), self.m - 1 - j)
        suffix = self._hash([heads[:, self.m - 1 - k] for k in range(self.block)])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.bucket = suffix[order], order
        self.prefix = self._prefix(heads, np.zeros(len(patterns), np.int64), rows=np.arange(len(patterns)))

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for k, c in enumerate(columns):
            h |= c.astype(np.uint64) << np.uint64(8 * k)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)

    def _prefix(self, text: np.ndarray, at: np.ndarray, rows=None) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.block):
            h |= (text[rows, k] if rows is not None else text[at + k]).astype(np.uint64) << np.uint64(8 * k)
        return h

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern number of every occurrence, in no order."""
        n, m = len(text), self.m
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, _STRETCH)
        stop = np.minimum(at + _STRETCH, n)
        stopped_at, keys = [], []
        while len(at):
            key = self._hash([text[at - k] for k in range(self.block)])
            shift = self.shift[key]
            zero = shift == 0
            if zero.any():
                stopped_at.append(at[zero])
                keys.append(key[zero])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, key = np.concatenate(stopped_at) - (m - 1), np.concatenate(keys)
        low, high = np.searchsorted(self.suffix, key), np.searchsorted(self.suffix, key, "right")
        size = high - low
        begin = np.repeat(begin, size)
        which = self.bucket[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
        same = self._prefix(text, begin) == self.prefix[which]
        begin, which = begin[same], which[same]
        whole = text.tobytes()
        right = np.fromiter((whole.startswith(self.patterns[p], b) for b, p in zip(begin.tolist(), which.tolist())), bool, len(begin))
        return begin[right], which[right]


class Detector:
    """All passes of tables over a benchmark's test strings."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, per_pass: int = PATTERNS_PER_PASS, least_words: int = LEAST_WORDS):
        found = strings(items, window, least_words)
        self.tables, self.ids = [], []
        for of_size in (lambda p: len(p) < SHORT, lambda p: len(p) >= SHORT):
            group = [p for p in found if of_size(p)]
            for i in range(0, len(group), per_pass):
                self.tables.append(WuManber(group[i : i + per_pass]))
                self.ids.append([found[p] for p in group[i : i + per_pass]])

    def scan(self, column):
        """``(row, item id, distinct test strings found)`` for a text column."""
        for row, raw, offsets in textkernel.slices(column):
            if not self.tables:
                return
            text, at = normalise(raw, offsets)
            hits: dict[tuple[int, object], set] = {}
            for k, (table, ids) in enumerate(zip(self.tables, self.ids)):
                begin, which = table.search(text)
                docs = np.searchsorted(at, begin, "right") - 1
                for d, p in zip(docs.tolist(), which.tolist()):
                    for item in ids[p]:
                        hits.setdefault((row + d, item), set()).add((k, p))
            for (d, item), which in sorted(hits.items(), key=lambda x: x[0][0]):
                yield d, item, len(which)


def _passes(benchmark: DataFrame, window: int, least_words: int, per_pass: int, item_col: str, text_col: str) -> tuple[int, Callable[[int], Broadcast]]:
    """How many passes the benchmark needs, and the broadcast tables of each."""
    items = frames.pick(benchmark, item=item_col, text=text_col)
    # every word begins a window at most; a run of marks counts as a word, which does no harm
    windows = items.select(F.sum(F.greatest(F.size(F.split("text", r"\s+")), F.lit(0)))).first()[0] or 0
    passes = max(1, -(-windows // per_pass))

    def table(number: int) -> Broadcast:
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number) if passes > 1 else items
        return benchmark.sparkSession.sparkContext.broadcast(Detector([tuple(r) for r in own.collect()], window, least_words=least_words))

    return passes, table


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, least_words: int = LEAST_WORDS, per_pass: int = PATTERNS_PER_PASS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows`` for every document and item that share a test string."""
    narrow = frames.pick(docs, doc_id=id_col, text=text_col)
    item = frames.pick(benchmark, item_id=item_col)
    item_type = to_arrow_type(item.schema["item_id"].dataType)
    passes, table = _passes(benchmark, window, least_words, per_pass, item_col, item_text_col)

    def found_by(shared: Broadcast) -> DataFrame:
        def run(stream):
            for batch in frames.batches(stream):
                found = list(shared.value.scan(batch.column(1)))
                if found:
                    rows, items, counts = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(items, item_type), pa.array(counts, pa.int64())], names=["doc_id", "item_id", "n_windows"])

        return narrow.mapInArrow(run, f"doc_id {frames.ddl(narrow, 'doc_id')}, item_id {frames.ddl(item, 'item_id')}, n_windows long")

    return reduce(DataFrame.union, [found_by(table(k)) for k in range(passes)])


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, least_words: int = LEAST_WORDS, per_pass: int = PATTERNS_PER_PASS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test string; no shuffle."""
    passes, table = _passes(benchmark, window, least_words, per_pass, item_col, item_text_col)

    def without(rows: DataFrame, shared: Broadcast) -> DataFrame:
        @F.arrow_udf("boolean")
        def clean(column: pa.Array) -> pa.Array:
            fine = np.ones(len(column), bool)
            fine[[row for row, _, _ in shared.value.scan(column)]] = False
            return pa.array(fine)

        return frames.keep_rows(rows, text_col, clean)

    left = without(docs, table(0))
    for k in range(1, passes):
        frames.ensure_checkpoints(docs.sparkSession)
        left = without(left.checkpoint(), table(k))
    return left


#: The same result by comparing every document with every test string.
ORACLE_SQL = f"""
WITH clean AS (
  SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')) || ' ' AS body FROM documents
), item AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ') AS w FROM benchmark
), test AS (
  SELECT DISTINCT item_id, ' ' || array_to_string(w[i : i + {WINDOW - 1}], ' ') || ' ' AS piece
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS i FROM item WHERE w[1] <> '' AND len(w) >= {LEAST_WORDS})
)
SELECT doc_id, item_id, count(*) AS n_windows FROM clean JOIN test ON contains(body, piece) GROUP BY doc_id, item_id
"""
