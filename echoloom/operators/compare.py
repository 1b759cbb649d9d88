"""Whether two copies of a table agree, over all rows and without a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_differences(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that only one side has or whose types differ."""
    a = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    return sorted(name for name in a.keys() | b.keys() if a.get(name) != b.get(name))


def compare_outputs(
    left: DataFrame, right: DataFrame, key: str = "review_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """Counts of rows, of keys on one side only, of keys whose values differ, per column, and of columns that differ.

    Values are compared for the columns that both sides have; a column of one side only, or of another type, is a finding.

    Both sides are stacked and aggregated by key. Per key and column the sums of the value hashes
    are compared, so repeated keys compare as multisets and are never paired with each other.
    The sums are fixed-width, so the aggregate hashes and combines on the map side.
    """
    ours = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    theirs = {f.name: f.dataType.simpleString() for f in right.schema.fields}
    compared = [c for c in (columns or left.columns) if c != key and c in ours and c in theirs]
    columns_apart = {
        "columns_left_only": sum(c not in theirs for c in ours), "columns_right_only": sum(c not in ours for c in theirs),
        "columns_type_differs": sum(c in theirs and theirs[c] != kind for c, kind in ours.items()),
    }

    def side(df: DataFrame, sign: int) -> DataFrame:
        hashes = [
            (F.xxhash64(F.lit(c), F.col(c), F.col(c).isNull()).cast("decimal(20,0)") * F.lit(sign))
            .cast("decimal(38,0)").alias(f"h_{i}")
            for i, c in enumerate(compared)
        ]
        return df.select(F.col(key).alias("_key"), F.lit(sign).alias("_side"), *hashes)

    stacked = side(left, 1).unionByName(side(right, -1))
    per_key = stacked.groupBy("_key").agg(
        F.count_if(F.col("_side") == 1).alias("n_left"),
        F.count_if(F.col("_side") == -1).alias("n_right"),
        *[F.sum(f"h_{i}").alias(f"d_{i}") for i in range(len(compared))],
    )
    shared = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    totals = per_key.agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).alias("rows_left"),
        F.coalesce(F.sum("n_right"), F.lit(0)).alias("rows_right"),
        F.count_if(F.col("n_right") == 0).alias("keys_left_only"),
        F.count_if(F.col("n_left") == 0).alias("keys_right_only"),
        F.count_if(shared & (F.col("n_left") != F.col("n_right"))).alias("keys_count_differs"),
        *[F.count_if(shared & (F.col(f"d_{i}") != 0)).alias(f"differs_{c}") for i, c in enumerate(compared)],
    )
    totals = totals.withColumns({name: F.lit(n).cast("long") for name, n in columns_apart.items()})
    findings = [c for c in totals.columns]
    rows = [F.struct(F.lit(c).alias("finding"), F.col(c).cast("long").alias("n")) for c in findings]
    return totals.select(F.inline(F.array(*rows)))
