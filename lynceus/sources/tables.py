"""Tables that survive a crash at any moment, as Parquet and small numbered files.

A version is written whole before a file with its number appears; the highest
number is current. Nothing that is current is ever deleted or renamed, so a
writer that dies leaves the version before it. One writer at a time.

``change`` replaces a table. ``change_keys`` is for a table with a key: rows lie
in ``buckets`` by a hash of the key, and a batch rewrites only the buckets that
it touches; the numbered file then lists where each bucket lies.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, place = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions, the current one last."""
    found = sorted(int(x) for x in _listed(spark, f"{path}/_versions") if x.isdigit())
    if not found and any(x.startswith("v=") and x != "v=0" for x in _listed(spark, path)):
        raise RuntimeError(f"{path} has versions, but no file says which is current")
    return found


def _save(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    fs, fresh = _fs(spark, f"{path}.new")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, place = _fs(spark, path)
    if not fs.rename(fresh, place):
        raise OSError(f"{path} could not be written")


def _load(spark: SparkSession, path: str) -> str:
    fs, place = _fs(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _forget(spark: SparkSession, path: str, versions: list[int]) -> None:
    for number in versions:
        fs, place = _fs(spark, f"{path}/_versions/{number}")
        fs.delete(place, False)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


def _places(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    """Bucket -> folder; one bucket, named ``all``, in a table without a key."""
    return json.loads(_load(spark, f"{path}/_versions/{number}"))["places"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The current version."""
    numbers = _numbers(spark, path)
    if not numbers:
        raise FileNotFoundError(path)
    saved = json.loads(_load(spark, f"{path}/_versions/{numbers[-1]}"))
    places = [f"{path}/{x}" for x in saved["places"].values()]
    if not places:
        return spark.createDataFrame([], saved["schema"])
    return spark.read.schema(saved["schema"]).parquet(*places)


def _commit(spark: SparkSession, path: str, number: int, schema: str, places: dict[str, str], keep: int) -> None:
    """Make a version current, and delete what the last ``keep`` versions don't need."""
    _save(spark, f"{path}/_versions/{number}", json.dumps({"schema": schema, "places": places}))
    numbers = _numbers(spark, path)
    gone, kept = numbers[:-keep], numbers[-keep:]
    needed = {x for k in kept for x in _places(spark, path, k).values()}
    for folder in {x for k in gone for x in _places(spark, path, k).values()} - needed:
        fs, place = _fs(spark, f"{path}/{folder}")
        fs.delete(place, True)
    _forget(spark, path, gone)


def write(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write the next version and make it current; all but the last ``keep`` versions go."""
    spark = df.sparkSession
    number = max(_numbers(spark, path), default=-1) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    _commit(spark, path, number, _ddl(df), {"all": f"v={number}"}, keep)
    return number


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def change(spark: SparkSession, path: str, empty: DataFrame, how: Callable[[DataFrame], DataFrame]) -> int:
    """Replace the table by ``how`` of it, or of ``empty`` where there is none yet."""
    return write(how(read(spark, path) if exists(spark, path) else empty), path)


def change_keys(spark: SparkSession, path: str, empty: DataFrame, key: Sequence[str], rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], *, buckets: int = BUCKETS, keep: int = 2) -> int:
    """Replace the buckets that the keys of ``rows`` fall in by ``how(those buckets, rows)``.

    ``how`` must not touch other keys than those of ``rows``. The number of
    buckets is the table's from its first version on.
    """
    numbers = _numbers(spark, path)
    saved = json.loads(_load(spark, f"{path}/_versions/{numbers[-1]}")) if numbers else {"places": {}}
    places = saved["places"]
    if "all" in places:
        raise ValueError(f"{path} was written without a key")
    buckets = int(next(iter(places), f"0/{buckets}").split("/")[1])
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    touched = [f"{r[0]}/{buckets}" for r in rows.select(bucket).distinct().collect()]  # no more than there are buckets
    old = [f"{path}/{places[b]}" for b in touched if b in places]
    number = max(numbers, default=-1) + 1
    before = spark.read.schema(empty.schema).parquet(*old) if old else empty
    how(before, rows).withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v={number}")
    fresh = {f"{x.removeprefix('_bucket=')}/{buckets}": f"v={number}/{x}" for x in _listed(spark, f"{path}/v={number}") if x.startswith("_bucket=")}
    _commit(spark, path, number, _ddl(empty), {k: v for k, v in places.items() if k not in touched} | fresh, keep)
    return number


def export_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
