"""Named tables: a handle on a session's catalogue, and a space that runs plans over its own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.nodes import Plan, Table, evaluate
from .frames import from_pandas, write_file


class SparkHandle:
    """Reads, writes and runs plans against a session's catalogue.  Results stay lazy DataFrames."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        """The session is the caller's; nothing to close."""

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def read_table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def describe_table(self, name: str) -> Table:
        return Table(name, tuple(self.spark.table(name).columns))

    def execute(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def read_query(self, query: Plan | str) -> DataFrame:
        return self.spark.sql(query) if isinstance(query, str) else evaluate(query, {n: t.frame if t.frame is not None else self.spark.table(n) for n, t in query.tables().items()})

    def to_sql(self, plan: Plan, options=None) -> str:
        """The plan as Spark SQL over the catalogue's tables."""
        return plan.to_sql({n: t.frame if t.frame is not None else self.spark.table(n) for n, t in plan.tables().items()}, options)

    def insert_table(self, frame, name: str, *, allow_overwrite: bool = False) -> Table:
        df = frame if isinstance(frame, DataFrame) else from_pandas(self.spark, frame)
        if self.table_exists(name) and not allow_overwrite:
            raise ValueError(f"table {name} exists")
        df.write.mode("overwrite").saveAsTable(name)
        return self.describe_table(name)

    def create_table(self, query: Plan | str, name: str, *, allow_overwrite: bool = False) -> Table:
        return self.insert_table(self.read_query(query), name, allow_overwrite=allow_overwrite)

    def drop_table(self, name: str, *, must_exist: bool = False) -> None:
        if must_exist and not self.table_exists(name):
            raise ValueError(f"no table {name}")
        self.spark.catalog.dropTempView(name)
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")

    def query_to_csv(self, query: Plan | str, path: str, **options) -> None:
        write_file(self.read_query(query), path, "csv", mode="overwrite", **options)


class SparkSpace:
    """A keyed store of tables, kept as temporary views and dropped on close."""

    def __init__(self, spark: SparkSession, prefix: str = "sp"):
        self.spark, self.prefix, self._tables, self._temp = spark, prefix, {}, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _view(self, key: str) -> str:
        return f"{self.prefix}_{id(self):x}_{key}"

    def insert(self, value, *, key: str | None = None, allow_overwrite: bool = True) -> Table:
        if key is None:
            self._temp += 1
            key = f"temp_{self._temp}"
        if key in self._tables and not allow_overwrite:
            raise ValueError(f"{key} is taken")
        df = value if isinstance(value, DataFrame) else from_pandas(self.spark, value)
        df.createOrReplaceTempView(self._view(key))
        self._tables[key] = df
        return Table(key, tuple(df.columns))

    def remove(self, key: str) -> None:
        del self._tables[key]
        self.spark.catalog.dropTempView(self._view(key))

    def keys(self) -> list[str]:
        return list(self._tables)

    def retrieve(self, key: str) -> DataFrame:
        return self._tables[key]

    def describe(self, key: str) -> Table:
        return Table(key, tuple(self._tables[key].columns))

    def execute(self, plan: Plan, *, key: str | None = None, allow_overwrite: bool = False) -> Table:
        """Keeps the plan's result, lazily, under a key."""
        return self.insert(evaluate(plan, dict(self._tables)), key=key, allow_overwrite=allow_overwrite)

    def close(self) -> None:
        for key in list(self._tables):
            self.remove(key)
