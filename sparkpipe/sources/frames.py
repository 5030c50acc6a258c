"""Tables from pandas, and files by Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "orc")


def _type_of(values: list) -> T.DataType:
    import datetime

    kinds = {type(v) for v in values}
    if not kinds:
        return T.StringType()
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if all(issubclass(k, datetime.datetime) for k in kinds):
        return T.TimestampNTZType()
    if all(issubclass(k, datetime.date) for k in kinds):
        return T.DateType()
    return T.StringType()


def from_rows(spark: SparkSession, columns: dict[str, list], types: dict[str, str] | None = None) -> DataFrame:
    """A small table of columns; types are those of the values, or given as DDL."""
    fields, cols = [], []
    for name, values in columns.items():
        values = [None if v is None or isinstance(v, float) and v != v else v for v in values]
        given = (types or {}).get(name)
        t = T._parse_datatype_string(given) if given else _type_of([v for v in values if v is not None])
        cols.append([float(v) if isinstance(t, T.DoubleType) and v is not None else v for v in values])
        fields.append(T.StructField(name, t))
    return spark.createDataFrame(list(zip(*cols, strict=True)), T.StructType(fields))


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A pandas table; NaN is null, as pandas has it."""
    return from_rows(spark, {c: [v.item() if hasattr(v, "item") else v.to_pydatetime() if hasattr(v, "to_pydatetime") else v for v in frame[c]] for c in frame.columns})


def read_file(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {FORMATS}")
    if fmt == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(fmt).options(**options).load(path)


def write_file(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {FORMATS}")
    if fmt == "csv":
        options = {"header": True} | options
    df.write.format(fmt).mode(mode).options(**options).save(path)
