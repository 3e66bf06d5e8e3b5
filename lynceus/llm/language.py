"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs. A letter's place in a
trigram is marked by rotating its vector, the three rotated vectors are bound by
multiplication, and a text is the sum (bundle) of its trigrams' vectors. The
prototype of a language is the bundle of the unit vectors of its labelled
documents; a document takes the language whose prototype has the largest
cosine with it.

Letters: a space for everything that isn't a letter, ``a`` to ``z``, and 37
symbols that the other letters share. Trigrams whose middle is a space are
left out. Trigram vectors are made when first met, and a run of documents is
bundled by one product of its trigram counts with the vectors.

Prototypes are fitted on every labelled document, in one pass that adds up a sum
for each language; a second pass over the same documents counts their cosines for
the floors. All documents are then identified. ``train(sample=n)`` fits on ``n``
documents only; no query does.

A document is rejected if it has no letters, if its best cosine is under the
floor for its length (no known language), or if its declared language is known
and beaten by more than ``MARGIN`` (it isn't what it says). The floors come from
the same documents: of those of a length, at the cosine that one in a hundred
reaches with the *other* languages' prototypes, as if its own were not known; but
no higher than where one in two hundred would be lost with its own, and no lower
than ``LEAST_COSINE``. All are counted, by cosines rounded to ``1 / STEPS``, but
languages of more than ``ALIKE`` documents weigh as much as one of ``ALIKE``, so that the
largest doesn't set the floor alone. A text of a few words can't be told apart,
and its floor is low.

Cases. Null, empty or letterless text: language null, cosine 0, rejected. Very
long text: all trigrams count. Ties: the language first in alphabetical order.
Null declared language: only the cosine decides. A declared language of which
fitting saw no letters is treated like a null one. Null ``doc_id`` and repeated
rows: fitted on and identified like any other. No labelled documents: every text
is rejected. A single language: floors of ``LEAST_COSINE``. Any number of languages:
each has a prototype (2 KB). Empty table: no rows. Extra columns: ignored by
``identify``, kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm import frames, textkernel

DIMENSIONS = 512
LANGUAGES = 256  # that share a sample, if one is asked for
LEAST_COSINE = 0.1
MARGIN = 0.2
LENGTHS = (32, 128)  # trigrams at which another floor begins
FOREIGN, OWN, ENOUGH = 0.99, 0.005, 20
STEPS, ALIKE = 10_000, 2_000
_WEIGHT = 1 << 32  # of one document; whole numbers add up alike in any order
_CELLS = 1 << 22  # cosines held at once
_SUMS = 4_096  # languages summed at once
_SYMBOLS = 64
_KNOWN = 0x3000
_ROWS = 256


def _symbol_table() -> np.ndarray:
    table = np.zeros(_KNOWN + 1, np.int32)
    for point in range(_KNOWN):
        if chr(point).isalpha():
            table[point] = point - 96 if 97 <= point <= 122 else 27 + point % 37
    return table


_SYMBOL = _symbol_table()


class Space:
    """Letter vectors, and trigram vectors made on demand."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions = dimensions
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_SYMBOLS, dimensions))
        self.row = np.full(_SYMBOLS**3, -1, np.int32)
        self.vectors = np.zeros((0, dimensions), np.int8)
        self.used = 0

    def trigrams(self, codes: np.ndarray) -> np.ndarray:
        fresh = codes[self.row[codes] < 0]
        if len(fresh):
            a, b, c = fresh // _SYMBOLS**2, fresh // _SYMBOLS % _SYMBOLS, fresh % _SYMBOLS
            made = np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]
            if self.used + len(made) > len(self.vectors):
                grown = np.zeros((max(4096, 2 * len(self.vectors), self.used + len(made)), self.dimensions), np.int8)
                grown[: self.used] = self.vectors[: self.used]
                self.vectors = grown
            self.vectors[self.used : self.used + len(made)] = made
            self.row[fresh] = np.arange(self.used, self.used + len(made))
            self.used += len(made)
        return self.vectors[self.row[codes]]

    def bundle(self, column) -> np.ndarray:
        """``(rows, dimensions)`` document vectors; zero where there are no trigrams."""
        return self.counted(column)[0]

    def counted(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The same, and the number of each document's trigrams."""
        out, trigrams = np.zeros((len(column), self.dimensions), np.float32), np.zeros(len(column), np.int64)
        for row, raw, offsets in textkernel.slices(column):
            docs = len(offsets) - 1
            doc, code, count = counts(raw, offsets)
            trigrams[row : row + docs] = np.bincount(doc, count, docs)
            for start in range(0, docs, _ROWS):
                low, high = np.searchsorted(doc, [start, start + _ROWS])
                if low == high:
                    continue
                kinds, at = np.unique(code[low:high], return_inverse=True)
                size = min(_ROWS, docs - start)
                table = np.zeros((size, len(kinds)), np.float32)
                table[doc[low:high] - start, at] = count[low:high]
                out[row + start : row + start + size] = table @ self.trigrams(kinds).astype(np.float32)
        return out, trigrams


def counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, trigram code and count, sorted by document."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    starts = before[offsets]
    symbol = np.where(points < _KNOWN, _SYMBOL[np.minimum(points, _KNOWN)], 27 + (points >> np.uint32(7)).astype(np.int32) % 37)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    # a space at both ends of each document, none beside another
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 0) | (symbol[:-1] != 0) | (doc[1:] != doc[:-1])
    symbol, doc = symbol[keep], doc[keep]
    n = len(symbol)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left[1:] = np.where(doc[1:] == doc[:-1], symbol[:-1], 0)
    right[:-1] = np.where(doc[1:] == doc[:-1], symbol[1:], 0)
    middle = symbol != 0
    key = (doc[middle] << 18) | (left[middle] * _SYMBOLS**2 + symbol[middle] * _SYMBOLS + right[middle])
    key.sort()
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[head] >> 18, key[head] & ((1 << 18) - 1), np.diff(np.append(head, len(key)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-9)


@dataclass
class Profiles:
    """Language names in order, a unit prototype of each, and the floor of each class of lengths."""

    names: list[str]
    prototypes: np.ndarray
    dimensions: int = DIMENSIONS
    floors: tuple[float, ...] = (LEAST_COSINE,) * (len(LENGTHS) + 1)

    def __post_init__(self):
        self._space = None

    def __getstate__(self):
        return self.__dict__ | {"_space": None}

    def compare(self, column, claim: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest prototype, cosines with it, with the claimed one (-1: none) and with the nearest but that, and numbers of trigrams."""
        if self._space is None:
            self._space = Space(self.dimensions)
        vectors, trigrams = self._space.counted(column)
        units, n = _unit(vectors), len(claim)
        best, (top, own, other) = np.zeros(n, np.int64), np.zeros((3, n), np.float32)
        step = max(1, _CELLS // len(self.names))
        for part in (slice(start, start + step) for start in range(0, n, step)):
            cosines, claimed = units[part] @ self.prototypes.T, claim[part]
            rows = np.arange(len(cosines))
            best[part] = cosines.argmax(axis=1)
            top[part] = cosines[rows, best[part]]
            own[part] = np.where(claimed >= 0, cosines[rows, claimed], top[part])
            cosines[rows[claimed >= 0], claimed[claimed >= 0]] = -np.inf
            other[part] = cosines.max(axis=1)
        return best, top, own, other, trigrams

    def places(self, declared: list[str | None]) -> np.ndarray:
        """Of each name its number, -1 if it is not known."""
        place = {name: i for i, name in enumerate(self.names)}
        return np.array([place.get(x, -1) for x in declared], np.int64)

    def judge(self, column, declared: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, cosine, and whether the document is accepted."""
        if not self.names:
            return [None] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        best, top, own, _, trigrams = self.compare(column, self.places(declared))
        some = trigrams > 0
        return [self.names[b] if s else None for b, s in zip(best, some)], np.where(some, top, 0.0).astype(float), some & (top >= np.array(self.floors)[_class(trigrams)]) & (top - own <= MARGIN)


def _class(trigrams: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, trigrams, "right")


def _quantile(values: np.ndarray, documents: np.ndarray, weights: np.ndarray, share: float) -> float:
    """``np.quantile`` of values that so many documents of that weight together have."""
    order = np.flatnonzero(documents)[np.argsort(values[documents > 0], kind="stable")]
    values, documents, weights = values[order], documents[order], weights[order].astype(np.float64)
    upto = np.cumsum(weights)
    # where the first and the last document of each value stand
    places = np.stack([upto - weights, upto - weights / documents], axis=1).ravel()
    return float(np.interp(share * places[-1], places, np.repeat(values, 2)))


def floors(own: np.ndarray, foreign: np.ndarray, trigrams: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, ...]:
    """Least cosine of each class of lengths, given cosines with the own prototype and the best other one.

    ``weights``: documents with the own cosine of each row and their weight, and the same of the foreign one; all 1 if not given.
    """
    out, kind = [], _class(trigrams)
    first, second = np.ones((2, 2, len(own)), np.int64) if weights is None else weights.reshape(2, 2, -1)
    for k in range(len(LENGTHS) + 1):
        at = kind == k
        enough = first[0, at].sum() >= ENOUGH and np.isfinite(foreign[at]).all()
        out.append(max(LEAST_COSINE, min(_quantile(own[at], *first[:, at], OWN), _quantile(foreign[at], *second[:, at], FOREIGN))) if enough else LEAST_COSINE)
    return tuple(out)


def _shares(narrow: DataFrame, sample: int) -> DataFrame:
    """Equal shares of ``sample`` documents, those of each common language whose ids hash lowest."""
    narrow = narrow.where("id is not null")
    common = narrow.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    share = sample // max(1, len(common))
    # a hash under the cut leaves about twice the share of a large language, of which the lowest are ranked
    cuts = narrow.sparkSession.createDataFrame([(r["lang"], min(1 << 31, (1 << 32) * (share + 50) // r["n"])) for r in common], "lang string, _cut long")
    hashed = narrow.select("id", "lang", F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("_hash")).join(F.broadcast(cuts), "lang").where("_hash < _cut").select("id", "lang", "_hash").distinct()
    rank = Window.partitionBy("lang").orderBy("_hash", "id")
    chosen = hashed.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= share).select("id", "lang")
    # the sample is bounded, so it may be broadcast; of texts with one id one is taken
    first = Window.partitionBy("id", "lang").orderBy(F.xxhash64("text"))
    return narrow.join(F.broadcast(chosen), ["id", "lang"]).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _added(parts) -> Iterator[pa.RecordBatch]:
    """Rows of ``lang, documents, vector``, one for each language but where there are very many, from names, numbers and sums."""
    sums: dict[str, list] = {}

    def rows():
        columns = [pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([v.tobytes() for _, v in sums.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "documents", "vector"])

    for name, number, vector in parts:
        if name not in sums and len(sums) >= _SUMS:
            yield rows()
            sums.clear()
        have = sums.setdefault(name, [0, np.zeros(DIMENSIONS, np.int64)])
        have[0] += number
        have[1] += vector
    yield rows()


def _sum(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of ``text, lang`` by language."""
    space = Space()

    def parts():
        for batch in frames.batches(stream):
            vectors, trigrams = space.counted(batch.column(0))
            whole = np.rint(_unit(vectors) * 1e6).astype(np.int32)  # whole numbers add up alike in any order
            coded = pc.dictionary_encode(batch.column(1))
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            order = order[trigrams[order] > 0]
            kinds, starts, numbers = np.unique(code[order], return_index=True, return_counts=True)
            for k, start, number in zip(kinds, starts, numbers):
                yield names[k], int(number), whole[order[start : start + number]].sum(axis=0, dtype=np.int64)

    return _added(parts())


def _merge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sums."""
    return _added((name, number, np.frombuffer(vector, np.int64)) for batch in frames.batches(stream) for name, number, vector in zip(*[c.to_pylist() for c in batch.columns]))


def _floors(narrow: DataFrame, profiles: Profiles, documents: list[int]) -> tuple[float, ...]:
    """Floors from the cosines of all documents, counted by class of lengths and rounded cosine."""
    weight = np.array([max(1, _WEIGHT * ALIKE // n) if n > ALIKE else _WEIGHT for n in documents])
    span, classes, fields = 2 * STEPS + 1, len(LENGTHS) + 1, ("own", "own_weight", "other", "other_weight")

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(fields), classes * span), np.int64)
        for batch in frames.batches(stream):
            claim = profiles.places(batch.column(1).to_pylist())
            _, _, own, other, trigrams = profiles.compare(batch.column(0), claim)
            some = trigrams > 0
            base, w = _class(trigrams[some]) * span + STEPS, weight[claim[some]]
            for row, x in ((0, own), (2, other)):
                cell = base + np.clip(np.rint(x[some] * STEPS), -STEPS, STEPS).astype(np.int64)
                np.add.at(seen[row], cell, 1)
                np.add.at(seen[row + 1], cell, w)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *seen[:, at])], names=["cell", *fields])

    counted = narrow.select("text", "lang").mapInArrow(count, ", ".join(f"{name} long" for name in ("cell", *fields)))
    table = counted.groupBy("cell").agg(*[F.sum(name).alias(name) for name in fields]).toArrow()
    cell, *weights = (table.column(name).to_numpy() for name in ("cell", *fields))
    cosine = (cell % span - STEPS) / STEPS
    return floors(cosine, cosine, np.array([0, *LENGTHS])[cell // span], np.array(weights))


def train(docs: DataFrame, *, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes and floors from every labelled document, or from equal shares of ``sample`` ones if that is given."""
    narrow = frames.pick(docs, id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    if sample is not None:
        narrow = _shares(narrow, sample)
    kind = "lang string, documents long, vector binary"
    # sorted, so that a language's sums meet even where there are very many languages
    parts = narrow.select("text", "lang").mapInArrow(_sum, kind).repartition("lang").sortWithinPartitions("lang").mapInArrow(_merge, kind)
    rows = sorted(parts.collect(), key=lambda r: r["lang"])
    if not rows:
        return Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    names = [r["lang"] for r in rows]
    sums = np.stack([np.frombuffer(r["vector"], np.int64) for r in rows])
    profiles = Profiles(names, _unit(sums.astype(np.float64)).astype(np.float32))
    if len(names) > 1:
        profiles.floors = _floors(narrow, profiles, [r["documents"] for r in rows])
    return profiles


def identify(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, language, cosine, accepted`` for every row of ``docs``."""
    narrow = frames.pick(docs, doc_id=id_col, text=text_col, lang=lang_col)

    def run(stream):
        for batch in frames.batches(stream):
            names, cosine, fine = profiles.judge(batch.column(1), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(cosine), pa.array(fine)], names=["doc_id", "language", "cosine", "accepted"])

    return narrow.mapInArrow(run, f"doc_id {frames.ddl(narrow, 'doc_id')}, language string, cosine double, accepted boolean")


def accepted(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are accepted, all columns as they were."""

    @F.arrow_udf("boolean")
    def fine(column: pa.Array, declared: pa.Array) -> pa.Array:
        return pa.array(profiles.judge(column, declared.to_pylist())[2])

    lang = F.col(f"_{frames.index_of(docs, lang_col)}")
    return frames.keep_rows(docs, text_col, lambda text: fine(text, lang))
