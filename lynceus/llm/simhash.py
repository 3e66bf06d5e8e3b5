"""Near-duplicate removal with SimHash fingerprints and BK-trees.

A document's fingerprint is the 128-bit SimHash of its distinct lower-case
words. Two documents are near copies if their fingerprints differ in at most
``radius`` bits, and groups are the connected components of that relation.

Search runs over BK-trees: every node's children are keyed by their integer
Hamming distance to it, and a query at distance ``d`` of a node descends only
along the edges ``d - radius .. d + radius``. One tree over a whole corpus
would compare nearly everything with everything, so fingerprints are dealt to
shards: ``T`` tables, each keyed by ``b`` sampled bits. A shard's tree holds
the fingerprints with one key of one table, and they are the queries of that
tree. The trees grow with the corpus, hence they are not broadcast: trees and
queries meet in the same task by a shuffle of narrow rows (24 bytes and a key).
``b`` follows the number of fingerprints such that a shard has about
``SHARD_ROWS`` of them, and ``T`` is then the least number of tables that finds
a pair *at* the radius with probability ``recall``; closer pairs are found with
a higher one. Nothing caps the partners of a document or the size of a shard.

All descendants of a node by its edge ``e`` are at distance ``e`` of it. So a
query within the radius of a node need not descend by edges up to the radius:
what hangs there is linked to the node already, and groups are all that is
asked for. A cluster of ``m`` close copies thus costs about ``m`` comparisons
and not ``m * m / 2``. A task emits its local components as stars, so a group
of thousands of copies costs thousands of edges and not millions. Identical
fingerprints are collapsed before the search. Nodes are fingerprints under
numbers of their own, so an id that carries different texts links nothing.

Cases. A document is a row: an id and a text. Null, empty or wordless text: no
fingerprint, a group of its own. Very long text: all words count. Ties: the
least ``doc_id`` of a group stays, and of several rows with that id the one
with the least fingerprint and text hash. Rows with the same id and the same
text are one document: one of them stays. One id with different texts: each
row is in the group of its own text, and a row of each group stays. Null
``doc_id``: the row is kept and belongs to no group. Empty table: no rows.
Extra columns: ignored by ``groups``, kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm import frames, textkernel

RADIUS = 22
RECALL = 0.95
SHARD_ROWS = 128
BITS = 128

_SIGNS = (((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1).astype(np.float32)
_LANES = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))


def fingerprints(column) -> tuple[np.ndarray, np.ndarray]:
    """``(n, 2)`` fingerprints of a text column, and which rows have one."""
    n = len(column)
    prints, present = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
    for row, raw, offsets in textkernel.slices(column):
        _, _, hashes, first = textkernel.words(raw, offsets)
        size = len(offsets) - 1
        present[row : row + size] = np.diff(first) > 0
        doc = np.repeat(np.arange(size), np.diff(first))
        salted = hashes ^ textkernel.mix(doc.astype(np.uint64) + np.uint64(1))
        order = np.argsort(salted)
        salted = salted[order]
        fresh = np.ones(len(salted), bool)
        fresh[1:] = salted[1:] != salted[:-1]
        hashes, doc = hashes[order][fresh], doc[order][fresh]
        base = doc * 256
        for lane, salt in enumerate(_LANES):
            mixed = textkernel.mix(hashes + salt)
            octets = mixed.view(np.uint8).reshape(-1, 8)
            bits = np.empty((size, 64), bool)
            for b in range(8):
                counts = np.bincount(base + octets[:, b], minlength=size * 256).reshape(size, 256)
                bits[:, 8 * b : 8 * b + 8] = counts.astype(np.float32) @ _SIGNS > 0
            prints[row : row + size, lane] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return prints, present


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64) + np.bitwise_count(a[:, 1] ^ b[:, 1])


class Forest:
    """BK-trees of many shards at once, as flat arrays.

    Trees are built level by level: of the rows that reached the same edge the
    first becomes a node, and the others go down its edge for their distance
    to it. The children of a node and their edges are ``child`` and ``edge``
    from ``begin`` of the node on, ``size`` of them, in the order of the edges.
    """

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        """``shard`` must be sorted; rows are nodes under their own index."""
        n = len(shard)
        self.lanes = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1])
        where = np.zeros(n, np.int64)
        if n:
            where[1:] = np.cumsum(shard[1:] != shard[:-1])
        rows, edges, children, self.roots = np.arange(n), [], [], np.zeros(n, np.int64)
        level = 0
        while len(rows):
            order = np.argsort(where, kind="stable")
            rows, where = rows[order], where[order]
            head = np.ones(len(rows), bool)
            head[1:] = where[1:] != where[:-1]
            group = np.cumsum(head) - 1
            node = rows[head][group]
            if level == 0:
                self.roots[rows] = node
            else:
                edges.append(where[head])
                children.append(rows[head])
            rest = ~head
            rows, node = rows[rest], node[rest]
            where = node * 256 + self.distance(rows, node)
            level += 1
        edge_of = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(edge_of)
        edge_of = edge_of[order]
        self.child = (np.concatenate(children) if children else np.zeros(0, np.int64))[order]
        self.edge = (edge_of & 255).astype(np.int16)
        self.begin = np.searchsorted(edge_of >> 8, np.arange(n + 1))
        self.size = np.diff(self.begin)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.lanes
        return np.bitwise_count(x[a] ^ x[b]).astype(np.int16) + np.bitwise_count(y[a] ^ y[b])

    def pairs(self, radius: int, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair of rows of one shard within the radius, each once."""
        return self._walk(radius, block, False)

    def links(self, radius: int, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius that connect all that ``pairs`` connects."""
        return self._walk(radius, block, True)

    def _walk(self, radius: int, block: int, connect: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(self.roots), block):
            query = np.arange(start, min(start + block, len(self.roots)))
            node = self.roots[query]
            while len(query):
                apart = self.distance(query, node)
                near = apart <= radius
                hit = near & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                inner = np.flatnonzero(self.size[node])
                query, node, apart = query[inner], node[inner], apart[inner]
                lowest = apart - radius
                if connect:  # edges up to the radius lead to what is linked to the node already
                    lowest = np.where(apart <= radius, radius + 1, lowest)
                size = self.size[node]
                flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.begin[node], size)
                edge, child, query = self.edge[flat], self.child[flat], np.repeat(query, size)
                # descendants come after their ancestors, so rows up to the query suffice
                follow = (edge >= np.repeat(lowest, size)) & (edge <= np.repeat(apart + radius, size)) & (child < query)
                query, node = query[follow], child[follow]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each row's component, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        live = low < high
        if not live.any():
            break
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def tables_for(n: int, radius: int, recall: float, shard_rows: int) -> tuple[int, int]:
    """Bits of a shard's key and number of tables for ``n`` fingerprints."""
    bits = max(8, min(32, math.ceil(math.log2(max(n, 1) / shard_rows)))) if n > shard_rows else 0
    chance = (1 - radius / BITS) ** bits
    return bits, 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - chance))


def shard_keys(prints: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """``(n, tables)`` keys: the table's number over its sampled bits."""
    rng = np.random.default_rng(20240229)
    out = np.zeros((len(prints), tables), np.int64)
    for t in range(tables):
        key = np.zeros(len(prints), np.uint64)
        for place in rng.permutation(BITS)[:bits]:
            lane, bit = divmod(int(place), 64)
            key = (key << np.uint64(1)) | ((prints[:, lane] >> np.uint64(bit)) & np.uint64(1))
        out[:, t] = key.astype(np.int64) + (t << 32)
    return out


def _as_prints(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1)], axis=1)


def _print_batches(stream):
    for batch in frames.batches(stream):
        prints, present = fingerprints(batch.column(1))
        lanes = [pa.array(prints[:, k].view(np.int64), mask=~present) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lanes], names=["doc_id", "text_hash", "fp0", "fp1"])


def _deal(bits: int, tables: int):
    def run(stream):
        for batch in frames.batches(stream):
            prints, nodes = _as_prints(batch), batch.column(2).to_numpy()
            for start in range(0, len(prints), 8192):
                part = prints[start : start + 8192]
                keys = shard_keys(part, bits, tables)
                lanes = np.repeat(part, tables, axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(lanes[:, 0]), pa.array(lanes[:, 1]), pa.array(np.repeat(nodes[start : start + 8192], tables))], names=["shard", "fp0", "fp1", "node"])

    return run


def _search(radius: int, rows: int = 1 << 17):
    """Trees over runs of whole shards of a partition sorted by shard."""

    def solve(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        shard = table.column(0).to_numpy()
        lanes = np.stack([table.column(i).to_numpy().view(np.uint64) for i in (1, 2)], axis=1)
        forest = Forest(shard, lanes)
        found = list(forest.links(radius))
        if not found:
            return None
        a, b = (np.concatenate(x) for x in zip(*found))
        nodes, place = np.unique(table.column(3).to_numpy(), return_inverse=True)  # a fingerprint is in several tables
        label = components(len(nodes), place[a], place[b])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])

    def run(stream):
        held, count = [], 0
        for batch in frames.batches(stream):
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            last = batch.column(0).to_numpy()
            cut = int(np.searchsorted(last, last[-1]))
            if cut == 0 and held[0].column(0)[0].as_py() == last[-1]:
                continue  # a single shard so far
            whole = held[:-1] + ([batch.slice(0, cut)] if cut else [])
            rest = []
            if cut == 0:  # the last shard began in an earlier batch
                while whole:
                    tail = whole[-1].column(0).to_numpy()
                    at = int(np.searchsorted(tail, last[-1]))
                    if at < len(tail):
                        rest.insert(0, whole[-1].slice(at))
                    whole[-1] = whole[-1].slice(0, at)
                    if at:
                        break
                    whole.pop()
            if whole and (out := solve(whole)) is not None:
                yield out
            held = [*rest, batch.slice(cut)]
            count = sum(x.num_rows for x in held)
        if held and (out := solve(held)) is not None:
            yield out

    return run


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge table ``(a, b)``; root is the least.

    Alternates large and small stars; each round is cut by a checkpoint in the
    session's shared folder, so a lost executor doesn't reach behind it.
    """
    spark = edges.sparkSession
    frames.ensure_checkpoints(spark)
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("low"), F.collect_set("b").alias("near"))
        large = around.select(F.explode("near").alias("x"), F.least("low", "a").alias("m"), "a").where("x > a and x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("low"), F.collect_set("b").alias("near"))
        after = (
            small.select("a", F.col("low").alias("b"))
            .unionByName(small.select(F.explode("near").alias("a"), F.col("low").alias("b")).where("a <> b"))
            .distinct()
            .checkpoint()
        )
        settled = after.join(state, ["a", "b"], "left_anti").limit(1).count() == 0 and state.join(after, ["a", "b"], "left_anti").limit(1).count() == 0
        state = after
        if settled:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _judged(docs: DataFrame, radius: int, recall: float, shard_rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, group_id, is_kept`` for every row of ``docs``."""
    spark = docs.sparkSession
    frames.ensure_checkpoints(spark)
    narrow = frames.pick(docs, doc_id=id_col, text=text_col)
    kind = frames.ddl(narrow, "doc_id")
    prints = narrow.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_print_batches, f"doc_id {kind}, text_hash long, fp0 long, fp1 long").checkpoint()
    whole = prints.where("fp0 is not null and doc_id is not null")
    # the numbers are written with the rows, so they stay what they are
    nodes = whole.groupBy("fp0", "fp1").agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id()).checkpoint()
    count = nodes.count()
    bits, tables = tables_for(count, radius, recall, shard_rows)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(count * tables / 500_000))
    roots = connected(
        nodes.select("fp0", "fp1", "node")
        .mapInArrow(_deal(bits, tables), "shard long, fp0 long, fp1 long, node long")
        .repartition(parts, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_search(radius), "a long, b long")
    )
    # fingerprints that are grouped with others; the rest stand for themselves
    of_group = Window.partitionBy("root").orderBy("low", "fp0", "fp1")
    grouped = (
        nodes.join(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "node")
        .select("fp0", "fp1", F.first("low").over(of_group).alias("_group"), (F.row_number().over(of_group) == 1).alias("_first"))
    )
    of_print = Window.partitionBy("fp0", "fp1").orderBy("doc_id", "text_hash")
    of_text = Window.partitionBy("doc_id", "text_hash").orderBy("text_hash")
    return (
        whole.select("*", F.first("doc_id").over(of_print).alias("_low"), F.row_number().over(of_print).alias("_nth"))
        .join(grouped, ["fp0", "fp1"], "left")
        .select("doc_id", "text_hash", F.coalesce("_group", "_low").alias("group_id"), ((F.col("_nth") == 1) & F.coalesce("_first", F.lit(True))).alias("is_kept"))
        .unionByName(prints.where("fp0 is null and doc_id is not null").select("doc_id", "text_hash", F.col("doc_id").alias("group_id"), (F.row_number().over(of_text) == 1).alias("is_kept")))
        .unionByName(prints.where("doc_id is null").select("doc_id", "text_hash", F.col("doc_id").alias("group_id"), F.lit(True).alias("is_kept")))
    )


def groups(docs: DataFrame, *, radius: int = RADIUS, recall: float = RECALL, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, group_id, is_kept`` for every row of ``docs``.

    ``group_id`` is the least ``doc_id`` of the near copies, the document's own
    id where it has none.
    """
    return _judged(docs, radius, recall, shard_rows, id_col, text_col).select("doc_id", "group_id", "is_kept")


def deduplicate(docs: DataFrame, *, radius: int = RADIUS, recall: float = RECALL, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, all its columns as they were."""
    judged = _judged(docs, radius, recall, shard_rows, id_col, text_col)
    drop = judged.where("doc_id is not null").groupBy(F.col("doc_id").alias("_drop"), F.col("text_hash").alias("_drop_hash")).agg(F.bool_or("is_kept").alias("_stays")).where("not _stays")
    key = F.col(f"_{frames.index_of(docs, id_col)}")
    rows = frames.positional(docs).withColumn("_hash", F.xxhash64(f"_{frames.index_of(docs, text_col)}"))
    # rows that repeat id and text meet under the key of the join
    rank = Window.partitionBy(key, "_hash").orderBy("_hash")
    return (
        rows.join(drop, (key == F.col("_drop")) & (F.col("_hash") == F.col("_drop_hash")), "left_anti")
        .withColumn("_rank", F.row_number().over(rank))
        .where(key.isNull() | (F.col("_rank") == 1))
        .drop("_rank", "_hash")
        .toDF(*docs.columns)
    )
