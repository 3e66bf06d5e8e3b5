"""DataFrame helpers shared by the corpus operators.

Operators address columns by position, so tables that carry extra columns whose
names clash (``text`` and ``TEXT``, or a column named like one of an operator's
results) are read without ambiguity. The first column whose name matches
exactly is the one used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.session import shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns named ``_0``, ``_1`` and so on."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def index_of(df: DataFrame, name: str) -> int:
    if name not in df.columns:
        raise ValueError(f"there is no column {name!r} among {df.columns}")
    return df.columns.index(name)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Just the wanted columns: ``pick(df, id="doc_id", text="text")``."""
    places = {out: index_of(df, name) for out, name in columns.items()}
    return positional(df).select(*[F.col(f"_{i}").alias(out) for out, i in places.items()])


def ddl(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def keep_rows(df: DataFrame, column: str, test: Callable) -> DataFrame:
    """Rows whose ``column`` passes ``test``; every column and name is kept."""
    at = index_of(df, column)
    return positional(df).where(test(F.col(f"_{at}"))).toDF(*df.columns)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoint to the session's shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold at least one row."""
    for batch in stream:
        if batch.num_rows:
            yield batch
