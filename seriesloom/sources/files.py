"""Readers and writers with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def _nulls(df: DataFrame) -> DataFrame:
    """NaN becomes null: it would count in sums and maxima."""
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})


def file_key(pattern: str) -> Column:
    """A group key from the file's name: the first group of `pattern`."""
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None, pattern: str = r"^(.*?)(?:__.*)?\.csv(?:\.gz)?$") -> DataFrame:
    """CSV files, gzipped or not, as one table; rows that don't fit the schema are errors. `key` names a column for the file's key."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    columns = list(df.columns)
    df = _nulls(df.withColumn(key, file_key(pattern)) if key else df)
    return df.select(*([key] if key else []), *columns)


def first_groups(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """The rows of the first n groups by key, or all."""
    return df if n is None else df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, expect: dict[str, str] | None = None) -> DataFrame:
    """Parquet with its columns pruned; `expect` maps columns to types that must be there. A leaf folder is read without its parents' partition columns."""
    df = spark.read.parquet(path)
    if expect and (wrong := {c: t for c, t in expect.items() if dict(df.dtypes).get(c) != t}):
        raise ValueError(f"{path} lacks {wrong}")
    return df.select(columns) if columns else df


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Refuses an existing path; partial output is never visible as complete."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.write.mode("errorifexists").option("header", True)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_submission(df: DataFrame, template: DataFrame, key: str, value: str, position: str, path: str) -> None:
    """(key, value) in the template's order, range-partitioned: part files in name order give the rows in order."""
    rows = template.select(key, position).join(df.select(key, value), key)
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism // 4)
    ordered = rows.repartitionByRange(parts, position).sortWithinPartitions(position)
    ordered.select(key, value).write.mode("errorifexists").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a row with sorted fields and no NaN."""
    _nulls(df).select(*sorted(df.columns)).write.mode("errorifexists").json(path)
