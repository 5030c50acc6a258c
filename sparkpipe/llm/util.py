"""What the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.components import connected_components
from ..sources.scratch import new_path, release_scratch, stored

__all__ = ["arrow_rows", "bounded", "connected_components", "free_names", "new_path", "number_rows", "read_table", "release_scratch", "splittable", "stored", "without_rows"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that df has no column of, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        name = f"_{w}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Stored rows of a few numbers each that a join may broadcast, about 20 MB as a hashed relation.
BROADCAST_ROWS = 200_000


#: Setting, Spark's default, and what takes its place: whole texts in batches of the default size fill an executor,
#: whose Java side holds a batch of each task outside its heap.
ARROW_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"))


def arrow_rows(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in small batches; a session that has set a size other than the default keeps it.

    Workers live on between tasks, so they give back what they don't use when a task ends.
    """
    conf = rows.sparkSession.conf
    for key, default, small in ARROW_BATCHES:
        if conf.get(key) == default:
            conf.set(key, small)

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(frugal, schema)


def give_back() -> None:
    """Returns free memory of this process to the system, where its C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc: nothing to return


def bounded(rows: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows stored, and marked for broadcast if they are counted and at most `most`; larger ones are joined by shuffle."""
    rows = stored(rows, name)
    return F.broadcast(rows) if rows.count() <= most else rows


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id (null like null) and content hash are in gone (doc_id, content)."""
    at, content = free_names(docs, "at", "content")
    gone = bounded(gone.select(F.col("doc_id").alias(at), F.col("content").alias(content)).distinct(), "gone")
    match = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(at)) & F.xxhash64(F.col(f"`{text_col}`")).eqNullSafe(F.col(content))
    return docs.join(gone, match, "left_anti")


def number_rows(spark: SparkSession, rows: list[tuple[int, ...]], schema: str | StructType) -> DataFrame:
    """Whole numbers of the driver as a local relation, without Python on the executors."""
    names = [c.split() for c in schema.split(", ")]
    one = ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in names)
    if not rows:
        return spark.sql(f"SELECT {one}").where("false")
    values = ", ".join(f"({', '.join(f'{v}L' for v in row)})" for row in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({name} AS {kind}) AS {name}' for name, kind in names)} FROM VALUES {values} AS t({', '.join(n for n, _ in names)})")


def splittable(key: str | Column) -> Column:
    """A one-to-one image of a long key.

    A side that comes out of an aggregate on `key` keeps its partitioning, and adaptive execution can't split a
    hot key of such a join.  Joining on the image makes both sides fresh exchanges, which it can split.
    """
    return F.bitwise_not(F.col(key) if isinstance(key, str) else key)
