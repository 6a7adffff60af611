"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..shipping import ship

#: Rows up to which a lookup side may be broadcast or held as a dictionary; it is
#: counted before each use, and beyond it the operators shuffle instead.
BROADCAST_ROWS = 300_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``."""
    return shared_folder(spark)


def materialise(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a materialised table that isn't read again."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def parts_of(df: DataFrame, by: str, rows: int = BROADCAST_ROWS) -> list[tuple[DataFrame, Column]]:
    """``df`` in parts of about ``rows`` rows at most, each with the condition on ``by`` that chooses the rows of another table it belongs to.

    For sides that are broadcast: beyond the bound the other table is read once a part, and no key of it is shuffled.
    ``df`` is materialised, and no value of ``by`` holds more than a small share of it.
    """
    n = max(1, -(-df.count() // rows))
    if n == 1:
        return [(df, F.lit(True))]
    part = F.pmod(F.xxhash64(by), F.lit(n))
    return [(df.where(part == k), part == k) for k in range(n)]


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be at most ``rows`` rows, else unchanged.

    The count is exact and cheap where ``df`` is a materialised table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chosen(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra or clashing columns of the input play no part."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
