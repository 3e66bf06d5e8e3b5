"""Best-fit packing of documents into token sequences, after Martello-Toth reduction.

Only lengths matter to a packing, and there are at most ``capacity`` of them.
So the instance that is solved is a histogram of lengths, whose size doesn't
depend on the number of documents; documents are then dealt to the places of
their length by their rank among the documents of that length. Ranks are counted
in salts of about ``SALT_ROWS`` pieces, as many as the length has need of, so
that no length is one task.

A document longer than the capacity is cut into pieces of the full capacity and
a rest. Every piece is placed. A piece of the full capacity is a bin by itself;
such pieces are numbered where they lie, without a shuffle, behind the other bins.

The reduction follows Martello and Toth. For an item ``j``, the feasible set
``{j}``, ``{j, k}`` or ``{j, a, b}`` may be fixed as a bin for good if it
dominates every other feasible set with ``j``, that is, if the items of the
other set can be parted so that each part fits in the place of one item of
this one:

* nothing else fits beside ``j``: ``{j}``;
* ``k`` fills the bin, or at most one more item fits and ``k`` is the largest:
  ``{j, k}``;
* at most two more items fit: ``{j, k}`` if ``k`` is as large as any two
  that fit, else ``{j, k, b}`` if ``b`` is as large as the smaller of any two.

Fixed sets leave the instance, and passes over it are repeated until nothing
changes. What is left is packed best-fit, largest first.

Cases. Null text or no tokens: no place is needed; bin and offset are null.
Ties: documents of one length are ranked by ``doc_id`` within a salt; rows that
repeat get a place each. Null ``doc_id``: ranked first. Very long text: as many pieces as
it needs. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm import frames, tokens

CAPACITY = 2048
SALT_ROWS = 1_000_000

Pattern = tuple[int, list[tuple[int, int]]]  # how many bins, and (length, how many) in each


class Reduction:
    """Fixes dominating sets of a histogram ``lengths -> counts``."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        for length, number in histogram.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} is not in 1..{capacity}")
            self.count[length] = number
        self.fixed: list[Pattern] = []

    def _fix(self, times: int, *lengths: int) -> None:
        inside: dict[int, int] = defaultdict(int)
        for length in lengths:
            inside[length] += 1
            self.count[length] -= times
        self.fixed.append((times, sorted(inside.items(), reverse=True)))

    def _dominating(self, j: int) -> tuple[int, ...] | None:
        """What may be fixed beside one item ``j``; None if nothing is proven."""
        room = self.capacity - j
        some = np.flatnonzero(self.count[: room + 1])
        if not len(some):
            return ()
        k = int(some[-1])
        if k == room:
            return (k,)
        smallest = np.repeat(some[:3], np.minimum(self.count[some[:3]], 3))[:3]
        if len(smallest) < 2 or smallest[:2].sum() > room:
            return (k,)
        if len(smallest) > 2 and smallest.sum() <= room:
            return None
        # the best partner of each item in a pair, itself only where there are two of it
        most = np.searchsorted(some, room - some, "right") - 1
        fits = most >= 0
        partner = some[np.maximum(most, 0)]
        alone = fits & (partner == some) & (self.count[some] < 2)
        most = most - alone
        fits &= most >= 0
        partner = some[np.maximum(most, 0)]
        if not fits.any():
            return (k,)
        if (some + partner)[fits].max() <= k:
            return (k,)
        if not fits[-1]:
            return None
        widest = int(np.minimum(some, partner)[fits].max())
        return (k, widest) if int(partner[-1]) >= widest and k + widest <= room else None

    def run(self) -> list[Pattern]:
        changed = True
        while changed:
            changed = False
            for j in range(self.capacity, 0, -1):
                while self.count[j]:
                    self.count[j] -= 1
                    beside = self._dominating(j)
                    self.count[j] += 1
                    if beside is None:
                        break
                    changed = True
                    need = [j, *beside]
                    times = min(int(self.count[x]) // need.count(x) for x in set(need))
                    if len(need) == 3:  # the proof may need one more of a kind
                        times = max(1, times - 2)
                    if len(need) == 1:
                        times = int(self.count[j])
                        if 2 * j <= self.capacity:  # j itself fits beside j, so it must be the last one
                            times = 1
                    self._fix(times, *need)
        return self.fixed


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, all equal bins at a time."""
    bins: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    rooms = 0  # bit r: there are bins with r left

    def put(room: int, times: int, inside: tuple[tuple[int, int], ...]) -> None:
        nonlocal rooms
        bins[room].append((times, inside))
        rooms |= 1 << room

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            roomy = rooms >> length
            if not roomy:
                whole, rest = divmod(left, capacity // length)
                if whole:
                    put(capacity - capacity // length * length, whole, ((length, capacity // length),))
                if rest:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            room = length + (roomy & -roomy).bit_length() - 1
            times, inside = bins[room].pop()
            if not bins[room]:
                rooms &= ~(1 << room)
            each = min(room // length, left)
            used = min(times, left // each)
            if used < times:
                put(room, times - used, inside)
            put(room - each * length, used, (*inside, (length, each)))
            left -= used * each
    return [(times, sorted(inside, reverse=True)) for group in bins.values() for times, inside in group]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bins for all items of the histogram: the fixed ones, then the rest."""
    reduction = Reduction({k: v for k, v in histogram.items() if v}, capacity)
    fixed = reduction.run()
    rest = {int(k): int(reduction.count[k]) for k in np.flatnonzero(reduction.count)}
    return fixed + best_fit(rest, capacity)


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, per bin, first bin, offset)`` of every run of equal places."""
    out, used, first = [], defaultdict(int), 0
    for times, inside in patterns:
        offset = 0
        for length, each in inside:
            out.append((length, used[length], used[length] + times * each, each, first, offset))
            used[length] += times * each
            offset += length * each
        first += times
    return out


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Pack a table ``(doc_id, n_tokens)``; see ``pack``."""
    spark = lengths.sparkSession
    frames.ensure_checkpoints(spark)
    size = F.coalesce("n_tokens", F.lit(0))
    pieces = (
        lengths.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / capacity) - 1, F.lit(0)))).alias("piece"), size.alias("_all"))
        .select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("_all") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
        .checkpoint()
    )
    partial = pieces.where(f"n_tokens > 0 and n_tokens < {capacity}")
    # at most as many rows as the capacity, whatever the number of documents
    histogram = {r[0]: r[1] for r in partial.groupBy("n_tokens").agg(F.count("*")).collect()}
    patterns = solve(histogram, capacity)
    runs = spark.createDataFrame(places(patterns), "_len int, _first long, _end long, _each int, _bin long, _at int")
    salts = spark.createDataFrame([(n, -(-count // salt_rows)) for n, count in histogram.items()], "n_tokens int, _salts int")
    salted = partial.join(F.broadcast(salts), "n_tokens").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts")).cast("int"))
    # one row for every salt_rows pieces, and one for each length
    before, seen = [], defaultdict(int)
    for length, salt, n in salted.groupBy("n_tokens", "_salt").agg(F.count("*")).orderBy("n_tokens", "_salt").collect():
        before.append((length, salt, seen[length]))
        seen[length] += n
    starts = spark.createDataFrame(before, "n_tokens int, _salt int, _before long")
    rank = Window.partitionBy("n_tokens", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(rank)).join(F.broadcast(starts), ["n_tokens", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    nth = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(runs), (F.col("n_tokens") == F.col("_len")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))).select(
        "doc_id",
        "piece",
        "n_tokens",
        (F.col("_bin") + F.floor(nth / F.col("_each"))).cast("long").alias("bin_id"),
        (F.col("_at") + F.pmod(nth, F.col("_each")) * F.col("n_tokens")).cast("int").alias("bin_offset"),
    )
    # the id of a row holds its partition and its number there; the pieces are written, so neither changes
    full = pieces.where(F.col("n_tokens") == capacity).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33).cast("int"))
    first, bases = sum(times for times, _ in patterns), []
    for part, n in full.groupBy("_part").agg(F.count("*")).orderBy("_part").collect():  # a row for each partition
        bases.append((part, first))
        first += n
    of_part = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))
    alone = full.join(of_part, "_part").select("doc_id", "piece", "n_tokens", (F.col("_base") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).alias("bin_id"), F.lit(0).alias("bin_offset"))
    nowhere = pieces.where("n_tokens <= 0").select("doc_id", "piece", "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_offset"))
    return placed.union(alone).union(nowhere)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, n_tokens, bin_id, bin_offset`` for every piece of every document."""
    return pack_lengths(tokens.counts(docs, vocabulary=vocabulary, id_col=id_col, text_col=text_col), capacity)


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins than this."""
    return math.ceil(sum(k * v for k, v in histogram.items()) / capacity)
