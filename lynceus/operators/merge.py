"""Keyed upserts between DataFrames.

Each takes the current table and a batch of rows and returns the new version of
the table; nothing is updated in place. ``owned`` are the columns that the batch
may change; the others keep the target's value, and are null in inserted rows.
The batch is reduced to one row for each key first: the last in ``order``, and of
rows that ``order`` doesn't tell apart the one whose other columns are greatest,
so the same batch gives the same table whenever it is run. Keys are matched
null-safely: a null key is a key like any other, and a batch that is replayed
changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus import schemas


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def last_by_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """One row for each key, the last in ``order``; ties go to the greatest of the other columns."""
    rest = [f.name for f in rows.schema if f.name not in key and f.name not in order and _orderable(f.dataType)]
    rank = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in [*order, *rest]] or [F.lit(0)])
    return rows.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def first_by_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    rank = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def _joined(target: DataFrame, batch: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = batch.withColumn("_in_batch", F.lit(True)).alias("s")
    return t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key], how)


def _lacking(rows: DataFrame, others: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key the other table doesn't have."""
    return rows.alias("l").join(others.select(*key).alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "left_anti")


def upsert(target: DataFrame, batch: DataFrame, key: Sequence[str], *, owned: Sequence[str] | None = None, order: Sequence[Column | str] = (), newest_only: str | None = None) -> DataFrame:
    """Update matched keys, insert the others.

    With ``newest_only``, a matched row is updated only if the batch's value of
    that column is not older than the target's.
    """
    batch = last_by_key(batch, key, order)
    changed = set(owned if owned is not None else [c for c in batch.columns if c not in key])
    hit = F.col("s._in_batch")
    if newest_only:
        hit = hit & (F.col("t._in_target").isNull() | F.col(f"t.{newest_only}").isNull() | (F.col(f"s.{newest_only}") >= F.col(f"t.{newest_only}")))
    rows = _joined(target, batch, key, "full_outer")
    return rows.select(*[
        F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c) if c in key
        else F.when(hit, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in changed and c in batch.columns
        else F.col(f"t.{c}").alias(c)
        for c in target.columns
    ])


def update_only(target: DataFrame, batch: DataFrame, key: Sequence[str], *, owned: Sequence[str] | None = None, order: Sequence[Column | str] = ()) -> DataFrame:
    """Update matched keys; batch rows without a match are ignored."""
    batch = last_by_key(batch, key, order)
    changed = set(owned if owned is not None else [c for c in batch.columns if c not in key])
    rows = _joined(target, batch, key, "left")
    return rows.select(*[F.when(F.col("s._in_batch"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in changed else F.col(f"t.{c}").alias(c) for c in target.columns])


def insert_only(target: DataFrame, batch: DataFrame, key: Sequence[str], *, order: Sequence[Column | str] = ()) -> DataFrame:
    """Append the rows whose key is new."""
    new = _lacking(last_by_key(batch, key, order), target, key)
    return target.unionByName(new.select(*[c for c in target.columns if c in new.columns]), allowMissingColumns=True)


def enqueue(queue: DataFrame, batch: DataFrame, known: DataFrame, key: Sequence[str], *, values: Sequence[str], done: str = "fetched", order: Sequence[Column | str] = ()) -> DataFrame:
    """Queue the keys that ``known`` lacks: new values win over old where not null, and the entry is open again."""
    batch = _lacking(last_by_key(batch, key, order), known, key)
    rows = _joined(queue, batch, key, "full_outer")
    return rows.select(*[
        F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c) if c in key
        else F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) if c in values
        else F.when(F.col("s._in_batch"), F.lit(False)).otherwise(F.col(f"t.{c}")).alias(c) if c == done
        else F.col(f"t.{c}").alias(c)
        for c in queue.columns
    ])


def drain(queue: DataFrame, arrivals: DataFrame, target: DataFrame, key: Sequence[str], *, overlay: Sequence[str], done: str = "fetched") -> tuple[DataFrame, DataFrame]:
    """New ``(target, queue)`` after fetching: arrived keys of open entries are upserted with the queue's overlay and closed; the rest stays open."""
    open_ = queue.where(~F.coalesce(F.col(done), F.lit(False)))
    got = arrivals.drop(*overlay).join(open_.select(*key, *overlay), list(key))
    closed = update_only(queue, got.select(*key).withColumn(done, F.lit(True)), key, owned=[done])
    return upsert(target, got, key), closed


def mark(target: DataFrame, batch: DataFrame, key: Sequence[str], flag: str, value: bool = True, only: Column | None = None) -> DataFrame:
    """Set a flag on the rows whose key is in the batch (and pass ``only``)."""
    return update_only(target, (batch if only is None else batch.where(only)).select(*key).withColumn(flag, F.lit(value)), key, owned=[flag])


def matched_counts(keys: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: how many of the keys the target has, and lacks."""
    rows = _joined(target.select(*key).distinct(), keys.select(*key).distinct(), key, "right")
    return rows.agg(F.count_if("_in_target").alias("matched"), F.count_if(F.col("_in_target").isNull()).alias("missing"))


def delete_where_in(target: DataFrame, parents: DataFrame, key: Sequence[str]) -> DataFrame:
    return _lacking(target, parents, key)


def replace_children(target: DataFrame, batch: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Delete the children of every parent in the batch, then insert the batch; columns that it lacks become null."""
    return delete_where_in(target, batch, parent).unionByName(batch, allowMissingColumns=True).select(*target.columns)


def upsert_tables(current: dict[str, DataFrame], fresh: dict[str, DataFrame], specs: dict[str, schemas.Table], parts: int | None = None) -> dict[str, DataFrame]:
    """Each table of ``fresh`` upserted by its specification's key, with its columns in order; a table that isn't there yet is taken as empty.

    ``parts`` are the partitions to look for a key's last row in; without it the planner
    counts by compressed bytes, which say little of long and repetitive texts.
    """
    out = dict(current)
    for name, rows in fresh.items():
        spec = specs[name]
        rows = schemas.conform(rows, spec)
        target = schemas.conform(current[name], spec) if name in current else rows.limit(0)
        rows = rows.where(" and ".join(f"`{k}` is not null" for k in spec.key))
        out[name] = upsert(target, rows.repartition(parts, *spec.key) if parts else rows, spec.key)
    return out


def backfill(target: DataFrame, rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Update some columns of matched keys; nulls of ``rows`` leave what was there."""
    batch = last_by_key(rows.select(*key, *columns), key)
    joined = _joined(target, batch, key, "left")
    return joined.select(*[F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) if c in columns else F.col(f"t.{c}").alias(c) for c in target.columns])
