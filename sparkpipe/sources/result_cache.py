"""Results of plans kept by what they were made of: the plan's text and a digest of each table's rows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..plans.nodes import Plan
from .scratch import new_path


def frame_digest(df: DataFrame) -> str:
    """Equal for tables with the same columns and the same rows, in whatever order; one aggregate, nothing is collected but four numbers."""
    row = [quoted(c) for c in df.columns]
    first, second = F.xxhash64(*row), F.xxhash64(F.lit(1), *row)
    total = df.agg(F.count(F.lit(1)), F.sum(first.cast("decimal(38,0)")), F.bit_xor(second), F.sum(second.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{df.schema.simpleString()} {tuple(map(str, total))}".encode()).hexdigest()


@dataclass(frozen=True)
class ResultKey:
    plan: str
    tables: tuple[tuple[str, str], ...]


@dataclass
class ResultCache:
    """Results as Parquet in a folder that driver and executors share; a new one beside the scratch tables if none is given."""

    spark: SparkSession
    folder: str | None = None
    dirty: bool = False
    results: dict[ResultKey, str] = field(default_factory=dict)

    def key(self, plan: Plan, tables: dict[str, DataFrame] | None = None) -> ResultKey:
        given = tables or {}
        frames = {n: given.get(n, t.frame) if given.get(n, t.frame) is not None else self.spark.table(n) for n, t in plan.tables().items()}
        return ResultKey(plan.to_python(), tuple((n, frame_digest(f)) for n, f in sorted(frames.items())))

    def get(self, plan: Plan, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """The stored result; KeyError if there is none."""
        return self.spark.read.parquet(self.results[self.key(plan, tables)])

    def store(self, plan: Plan, result: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """Keeps result, and gives it back as stored.  One that is there already stays if it has the same rows."""
        key = self.key(plan, tables)
        if key in self.results and frame_digest(self.spark.read.parquet(self.results[key])) == frame_digest(result):
            return self.spark.read.parquet(self.results[key])
        path = new_path(self.spark, "result") if self.folder is None else f"{self.folder.rstrip('/')}/{hashlib.sha256(repr(key).encode()).hexdigest()}"
        result.write.mode("overwrite").parquet(path)
        self.results[key], self.dirty = path, True
        return self.spark.read.parquet(path)

    def evaluate(self, plan: Plan, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """The plan's result, run once for the same plan and rows."""
        try:
            return self.get(plan, tables)
        except KeyError:
            return self.store(plan, plan.evaluate(tables), tables)
