"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (sizes, character classes, repetition of words, word pairs
and lines) are computed from its bytes by numpy. Trees are grown level by level
on features cut into at most ``BINS`` quantile bins, from the gradient and
hessian histograms of the logistic loss. The fitted forest is three flat
arrays in heap order (feature, threshold, leaf value), and a batch of documents
walks all trees at once, one numpy step a level.

The model is fitted on a bounded sample: the ``SAMPLE`` labelled rows whose
``doc_id`` hashes lowest. Everything else covers every row.

Cases. Null text: scored like an empty one. Very long text: all of it counts.
Null label or ``doc_id``: not used for fitting, but scored. Labels of one class
only, or none: the score is the share of good labels (1 where there are none).
Rows that repeat are scored each. Empty table: no rows. Extra columns: ignored
by ``scores``, kept by ``accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm import frames, textkernel

SAMPLE = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
THRESHOLD = 0.5

FEATURES = ("log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "marks", "stops", "spaces", "wide", "distinct_words", "adjacent_repeats", "distinct_pairs", "commonest_word", "lines_per_word", "repeated_lines")


def _flags(*chars: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    for group in chars:
        table[np.frombuffer(group.encode("latin-1"), np.uint8)] = 1
    return table


_CLASSES = (
    _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _flags("0123456789"),
    _flags("#$%&*+/<=>@[\\]^_`{|}~"),
    _flags("!?"),
    _flags(".,;:"),
    _flags(" \t\n\r"),
    _flags(bytes(range(128, 256)).decode("latin-1")),
)


def _fresh(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, those that differ from the one before."""
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


def _distinct(keys: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: distinct keys, and how often its commonest occurs."""
    order = np.argsort(textkernel.mix(keys ^ textkernel.mix(doc.astype(np.uint64) + np.uint64(7))))
    keys, doc = keys[order], doc[order]
    new = _fresh(keys) | _fresh(doc)
    at = np.flatnonzero(new)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(keys))))
    return np.bincount(doc[at], minlength=docs), most


def features(column) -> np.ndarray:
    """``(rows, len(FEATURES))`` statistics of a text column."""
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for row, raw, offsets in textkernel.slices(column, lower=False):
        docs = len(offsets) - 1
        starts, ends, hashes, first = textkernel.words(raw, offsets)
        n_bytes, n_words = np.diff(offsets), np.diff(first)
        doc = np.repeat(np.arange(docs), n_words)
        length = ends - starts
        sums = []
        for table in _CLASSES:
            total = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(table[raw], out=total[1:])
            sums.append(total[offsets[1:]] - total[offsets[:-1]])
        longest = np.zeros(docs, np.int64)
        np.maximum.at(longest, doc, length)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        distinct, most = _distinct(hashes, doc, docs)
        pairs, _ = _distinct(textkernel.mix(hashes[pair]) + hashes[pair + 1], doc[pair], docs)
        line_start, line_end, line_first = textkernel.runs(raw != 10, offsets)
        lines = np.diff(line_first)
        line_doc = np.repeat(np.arange(docs), lines)
        line_kinds, _ = _distinct(textkernel.span_hash(textkernel.prefix_hash(raw), line_start, line_end), line_doc, docs)
        per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)
        out[row : row + docs] = np.stack(
            [
                np.log1p(n_bytes), np.log1p(n_words), np.bincount(doc, length, docs) * per_word, np.log1p(longest),
                *[s * per_byte for s in sums],
                distinct * per_word, np.bincount(doc, same, docs) * per_word, pairs / np.maximum(n_words - 1, 1), most * per_word,
                lines * per_word, 1 - line_kinds / np.maximum(lines, 1),
            ],
            axis=1,
        )
    return out


@dataclass
class Forest:
    """Trees in heap order: node ``i`` has the children ``2i+1`` and ``2i+2``."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Probability of good quality for each row."""
        trees, inner = self.feature.shape
        margin = np.full(len(x), self.prior)
        tree = np.arange(trees)[None, :]
        for start in range(0, len(x) if trees else 0, block):
            part = x[start : start + block]
            row, node = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64)
            while inner and node[0, 0] < inner:
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            margin[start : start + block] += self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Boosted trees on features ``x`` and labels ``y`` of 0 and 1."""
    good = float(y.mean()) if len(y) else 1.0
    if good in (0.0, 1.0):
        return Forest(40.0 if good else -40.0, np.zeros((0, 1), np.int64), np.zeros((0, 1), np.float32), np.zeros((0, 2)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(width)]
    codes = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)  # code k: above cut k-1, up to cut k
    prior = float(np.log(good / (1 - good)))
    margin = np.full(n, prior)
    inner = (1 << depth) - 1
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    column = np.arange(width)[None, :]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, count = (1 << level) - 1, 1 << level
            at = (((node - base)[:, None] * width + column) * bins + codes).ravel()
            sums = [np.bincount(at, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < 2) | (ht - hl < 2)] = 0
            for k in range(count):
                j, b = divmod(int(gain[k].argmax()), bins)
                if gain[k, j, b] > 1e-3 and b < len(cuts[j]):
                    feature[t, base + k], threshold[t, base + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[t][leaf]
    return Forest(prior, feature, threshold, value)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fit on the ``sample`` labelled rows whose ids hash lowest."""
    chosen = frames.pick(labels, id=id_col, y=label_col).where("id is not null and y is not null").orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    narrow = frames.pick(docs, id=id_col, text=text_col)

    def run(stream):
        for batch in frames.batches(stream):
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.float32).tobytes()[i * x.shape[1] * 4 : (i + 1) * x.shape[1] * 4] for i in range(len(x))), batch.column(1)], names=["x", "y"])

    # the sample is bounded, so it may be broadcast; of texts with one id one is taken
    first = Window.partitionBy("id", "y").orderBy(F.xxhash64("text"))
    rows = narrow.join(F.broadcast(chosen.distinct()), "id").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "x binary, y int").collect()
    rows.sort(key=lambda r: (bytes(r[0]), r[1]))
    x = np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[1] > 0 for r in rows], float))


def scores(docs: DataFrame, model: Forest, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, quality_score, accepted`` for every row of ``docs``."""
    narrow = frames.pick(docs, doc_id=id_col, text=text_col)

    def run(stream):
        for batch in frames.batches(stream):
            p = model.predict(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "quality_score", "accepted"])

    return narrow.mapInArrow(run, f"doc_id {frames.ddl(narrow, 'doc_id')}, quality_score double, accepted boolean")


def accepted(docs: DataFrame, model: Forest, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns as they were."""

    @F.arrow_udf("boolean")
    def good(column: pa.Array) -> pa.Array:
        return pa.array(model.predict(features(column)) >= threshold)

    return frames.keep_rows(docs, text_col, good)
