"""Incremental loads: watermarks, date slices, run audit, streaming upserts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lynceus.operators import merge
from lynceus.sources import tables

EARLIEST = dt.date(2000, 1, 1)


def resolve_window(today: dt.date, watermark: dt.date | None = None, newest: dt.date | None = None, forced_start: dt.date | None = None, forced_end: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Days to load, both ends included: as forced, else from the day after the watermark, else from the newest row, else from 2000.

    The end is today; it is moved up to the start if it lies before it.
    """
    start = forced_start or (watermark + dt.timedelta(days=1) if watermark else newest or EARLIEST)
    end = forced_end or today
    return start, max(start, end)


def slices(start: dt.date, end: dt.date, days: int = 7) -> list[tuple[dt.date, dt.date]]:
    """Consecutive slices of at most ``days`` days, both ends included."""
    out = []
    while start <= end:
        last = min(start + dt.timedelta(days=days - 1), end)
        out.append((start, last))
        start = last + dt.timedelta(days=1)
    return out


def slice_rows(bounds: DataFrame, days: int = 7, start: str = "start", end: str = "end") -> DataFrame:
    """``slice_start, slice_end`` for rows with a start and an end."""
    begin = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {days} DAYS")))
    return bounds.select(begin.alias("slice_start"), F.col(end).alias("_end")).select("slice_start", F.least(F.date_add("slice_start", days - 1), F.col("_end")).alias("slice_end"))


def advance(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert watermarks; a null leaves what was there."""
    value = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c)
    return checkpoints.alias("t").join(merge.last_by_key(rows, ["source"]).alias("s"), F.col("t.source") == F.col("s.source"), "full_outer").select(*[value(c) for c in checkpoints.columns])


def start_run(runs: DataFrame, row: DataFrame) -> DataFrame:
    return merge.insert_only(runs, row, ["run_id"])


def complete_run(runs: DataFrame, row: DataFrame) -> DataFrame:
    """Fill in a run's end, status and counters; nulls leave what was there."""
    batch = merge.last_by_key(row, ["run_id"])
    value = lambda c: (F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")) if c in batch.columns and c != "run_id" else F.col(f"t.{c}")).alias(c)
    return runs.alias("t").join(batch.alias("s"), F.col("t.run_id") == F.col("s.run_id"), "left").select(*[value(c) for c in runs.columns])


def unsynced(table: DataFrame, flag: str, want: bool = False) -> DataFrame:
    """Rows whose flag has (``want``) or lacks a mark."""
    mark = F.coalesce(F.col(flag), F.lit(False))
    return table.where(mark if want else ~mark)


def clear(table: DataFrame, synced: DataFrame, key: Sequence[str], flag: str, value: bool) -> DataFrame:
    """Write a flag back for the rows that were synchronised."""
    return merge.mark(table, synced, key, flag, value)


def load_stream(spark: SparkSession, source: str, schema: StructType, target: str, empty: DataFrame, key: Sequence[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, *, order: Sequence[Column | str], owned: Sequence[str] | None = None, files_per_batch: int | None = None, counters: Callable[[dict], None] = lambda c: None):
    """Upsert everything that has landed in a folder, then stop.

    The stream's checkpoint is the watermark: a file is taken once. The upsert
    is by key and rewrites only the buckets that a batch touches; ``order``
    says which of a batch's rows with one key is the last. So a batch that is
    repeated after a failure changes nothing. ``counters`` gets a dictionary for
    each batch: its number, lines read, rows that ``transform`` made of them,
    rejected ones (a null in the key), keys updated and inserted.
    """
    if not order:
        raise ValueError("an order must say which row of a key is the last")

    def batch(lines: DataFrame, number: int) -> None:
        lines = lines.persist()
        made = transform(lines).persist()
        try:
            usable = made.where(" and ".join(f"`{k}` is not null" for k in key))
            last = merge.last_by_key(usable, key, order)
            before = tables.read(spark, target) if tables.exists(spark, target) else empty
            hits = merge.matched_counts(usable, before, key).first()
            read, rows, good = lines.count(), made.count(), usable.count()
            tables.change_keys(spark, target, empty, key, last, lambda t, b: merge.upsert(t, b, key, owned=owned))
            counters({"batch": number, "lines": read, "rows": rows, "rejected": rows - good, "updated": hits["matched"], "inserted": hits["missing"]})
        finally:
            made.unpersist()
            lines.unpersist()

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = reader.json(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
    return query
