"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_released: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it may be unset, a folder beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sparkpipe"
    return base.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sparkpipe-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own; what is there goes when the driver's Python ends, if not before."""
    if (own := _own_dir(spark)) not in _released:
        _released.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that a join may broadcast, about 20 MB as a hashed relation.
BROADCAST_ROWS = 200_000

#: While tasks are kept small: MB that one reads of files or of a coalesced shuffle, and rows of a shuffle's partition.
TASK_MB, TASK_ROWS = 8, 250_000


@contextmanager
def small_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Until it ends, jobs of this session run in more and smaller tasks, whose memory doesn't grow with the input.

    Larger sizes of the session are lowered, and its shuffle partitions raised to hold `rows`; smaller tasks stay as they
    are.  It holds for what is run meanwhile, as by `stored`, not for what is still lazy when it ends.
    """
    conf, size = spark.conf, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    now = {}
    for key, most in (("spark.sql.files.maxPartitionBytes", TASK_MB), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_MB), ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", 4 * TASK_MB)):
        if size(conf.get(key)) > most << 20:
            now[key] = f"{most}m"
    if int(conf.get("spark.sql.shuffle.partitions")) < (parts := -(-rows // TASK_ROWS)):
        now["spark.sql.shuffle.partitions"] = str(parts)
    before = {key: conf.get(key) for key in now}
    try:
        for key, value in now.items():
            conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            conf.set(key, value)


def release_scratch(spark: SparkSession) -> None:
    """Removes every scratch table of this application; results not yet computed that read them are lost."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, own: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone, and its folder with it
        pass
