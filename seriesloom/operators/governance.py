"""Guards that keep truth away until predictions are fixed, and checks of what is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import is_finite
from seriesloom.operators import joins, uniqueness

FORBIDDEN = ("truth", "true_", "error", "oracle", "target", "label")


class LeakError(ValueError):
    """Truth was asked for, or would be seen, before predictions were fixed."""


def allowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the allowed columns; the scan then never reads others."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(columns)


def assert_no_forbidden(df: DataFrame, tokens: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    if bad := [c for c in df.columns if any(t in c.lower() for t in tokens)]:
        raise LeakError(f"columns that show the truth: {bad}")
    return df


def content_hash(df: DataFrame, keys: list[str]) -> str:
    """SHA-256 of a table whatever its layout: rows are hashed, grouped by hash prefix, and 4096 sums hashed in order.

    Columns count by name order. Null differs from empty text; rows that repeat count.
    """
    columns = [*keys, *sorted(c for c in df.columns if c not in keys)]
    parts = [F.coalesce(F.concat(F.lit("v"), F.base64(F.col(c).cast("string").cast("binary"))), F.lit("n")) for c in columns]
    rows = df.select(F.sha2(F.concat_ws(",", *parts).cast("binary"), 256).alias("h"))
    sums = rows.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.count("*").alias("n"), *(F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)))
    one = sums.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "n", *(f"s{i}" for i in range(5))))), ";").alias("t"))  # 4096 rows at most
    head = ",".join(columns)
    return one.select(F.sha2(F.concat(F.lit(head + "|"), F.coalesce("t", F.lit(""))).cast("binary"), 256)).first()[0]


class Ledger:
    """Counts reads of the truth, and refuses them until the predictions' hash is fixed."""

    def __init__(self) -> None:
        self.frozen: str | None = None
        self.reads = 0

    def freeze(self, predictions: DataFrame, keys: list[str]) -> str:
        self.frozen = content_hash(assert_no_forbidden(predictions), keys)
        return self.frozen

    def attach_truth(self, predictions: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
        if self.frozen is None or content_hash(predictions, keys) != self.frozen:
            raise LeakError("predictions aren't those that were frozen")
        self.reads += 1
        return joins.validated_join(predictions, truth, keys, complete=True)


def promotion_gate(df: DataFrame, scope: list[str], key: str, base: str, new: str, truth: str, worst: float) -> DataFrame:
    """(scope, base_rmse, new_rmse, worst_loss, passes): better in the scope, and no group loses more than `worst`."""
    e = lambda c: F.pow(F.col(c) - F.col(truth), 2)
    groups = df.groupBy(*scope, key).agg(F.sum(e(base)).alias("b"), F.sum(e(new)).alias("n"), F.count("*").alias("rows"))
    got = groups.groupBy(scope).agg(F.sqrt(F.sum("b") / F.sum("rows")).alias("base_rmse"), F.sqrt(F.sum("n") / F.sum("rows")).alias("new_rmse"), F.max(F.sqrt(F.col("n") / F.col("rows")) - F.sqrt(F.col("b") / F.col("rows"))).alias("worst_loss"))
    return got.withColumn("passes", (F.col("new_rmse") < F.col("base_rmse")) & (F.col("worst_loss") <= worst))


def merge_shards(shards: list[DataFrame], expected: DataFrame, keys: list[str]) -> DataFrame:
    """The union of shards whose keys neither overlap nor differ from those expected."""
    out = uniqueness.unique_across(shards, keys)
    if not joins.same_keys(expected, out, keys):
        raise ValueError("shards don't cover the expected keys")
    return out


def validate_submission(df: DataFrame, template: DataFrame, key: str, value: str) -> DataFrame:
    """`df` if it has just the two columns, each key once, as in the template, and finite values."""
    if df.columns != [key, value]:
        raise ValueError(f"columns must be {[key, value]}")
    joins.require_unique(df, [key], "submission")
    if not joins.same_keys(template, df, [key]):
        raise ValueError("keys differ from the template's")
    if df.where(~is_finite(value)).limit(1).count():
        raise ValueError("values must be finite")
    return df


def markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows of an ordered table as Markdown."""
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("-" if v is None or v == "" else str(v) for v in r) + " |\n" for r in df.limit(rows).collect())
