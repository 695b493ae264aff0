"""Tables that are published only if they are what was expected, found out in the pass that writes them."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seriesloom.functions.scalars import is_finite


class Expected(NamedTuple):
    """What a table must be: its number of rows (or a range of it), the rows of each value of a column, columns without null or non-finite values, and its digest."""

    rows: int | tuple[int, int] | None = None
    groups: dict[str, dict] = {}
    finite: tuple[str, ...] = ()
    digest: str | None = None


class UnexpectedTable(ValueError):
    """A table isn't what was declared; nothing was published."""


def digest_parts(df: DataFrame) -> list[Column]:
    """Sums over rows of five pieces of the SHA-256 of each row: equal for equal rows in any order, different if a row differs or repeats."""
    values = [F.coalesce(F.concat(F.lit("v"), F.base64(F.col(f"`{c}`").cast("string").cast("binary"))), F.lit("n")) for c in sorted(df.columns)]
    row = F.sha2(F.concat_ws(",", F.lit(",".join(sorted(df.columns))), *values).cast("binary"), 256)
    return [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"__digest{i}") for i in range(5)]


def digest_of(values: dict) -> str:
    return ":".join(str(values[f"__digest{i}"] or 0) for i in range(5))


def digest(df: DataFrame) -> str:
    """The digest that `Expected` compares."""
    return digest_of(df.agg(*digest_parts(df)).first().asDict())


def _metrics(df: DataFrame, expected: Expected) -> list[Column]:
    out = [F.count(F.lit(1)).alias("__rows")]
    for i, (column, counts) in enumerate(sorted(expected.groups.items())):
        known = F.lit(False)
        for j, value in enumerate(sorted(counts, key=str)):
            same = F.col(column).eqNullSafe(F.lit(value))
            known = known | same
            out.append(F.count_if(same).alias(f"__group{i}_{j}"))
        out.append(F.count_if(~known).alias(f"__others{i}"))
    out += [F.count_if(~F.coalesce(is_finite(F.col(c)), F.lit(False))).alias(f"__bad{i}") for i, c in enumerate(expected.finite)]
    return out + (digest_parts(df) if expected.digest is not None else [])


def _differences(got: dict, expected: Expected) -> list[str]:
    out = []
    low, high = expected.rows if isinstance(expected.rows, tuple) else (expected.rows, expected.rows)
    if low is not None and not low <= got["__rows"] <= high:
        out.append(f"{got['__rows']} rows instead of {low if low == high else f'{low} to {high}'}")
    for i, (column, counts) in enumerate(sorted(expected.groups.items())):
        for j, value in enumerate(sorted(counts, key=str)):
            if (n := got[f"__group{i}_{j}"]) != counts[value]:
                out.append(f"{n} rows of {column} {value!r} instead of {counts[value]}")
        if got[f"__others{i}"]:
            out.append(f"{got[f'__others{i}']} rows of other values of {column}")
    out += [f"{got[f'__bad{i}']} values of {c} that are missing or not finite" for i, c in enumerate(expected.finite) if got[f"__bad{i}"]]
    if expected.digest is not None and digest_of(got) != expected.digest:
        out.append("rows that differ from those of the digest")
    return out


def publish(df: DataFrame, path: str, expected: Expected, partition_by: tuple[str, ...] = ()) -> dict:
    """Writes `df` as Parquet to `path`, which must not be there yet, if it is as expected; returns what was counted.

    The table is written beside `path` and counted as it is written, in one pass; only if all counts are right
    is it renamed. If not, what was written is deleted and `UnexpectedTable` names every difference. Where renaming isn't
    atomic (object stores) readers must wait for `_SUCCESS`.
    """
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    final = fs_path(path)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    beside = f"{path.rstrip('/')}.unchecked-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, *_metrics(df, expected)).write
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(beside)
        got = seen.get
        if wrong := _differences(got, expected):
            raise UnexpectedTable(f"{path}: " + "; ".join(wrong))
        if not fs.rename(fs_path(beside), final):
            raise OSError(f"{beside} can't be renamed")
    except BaseException:
        fs.delete(fs_path(beside), True)
        raise
    return got
