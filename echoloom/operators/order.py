"""Exact positions in input order, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoloom.session import materialize

_ROW_BITS = 33


def with_position(
    df: DataFrame, groups: Sequence[str] = (), date: str = "date", identifier: str = "review_id"
) -> DataFrame:
    """Add ``position``: the row's 0-based place in its group by (date, identifier).

    A window over the group would send each theme to one task. Instead the table is cut into ranges of (group,
    date, identifier), of even size whatever the identifiers look like, and sorted within them. Each row is numbered in its
    range, and the rows are written with that number once, since ranges are sampled anew at each evaluation. What is
    left is one small row per group and range: where the group starts in the range, and how many of its rows came before.

    Nulls in any of the columns are values like others and come first; no row is lost.
    """
    ranged = df.repartitionByRange(*groups, date, identifier).sortWithinPartitions(*groups, date, identifier)
    placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_range", F.shiftrightunsigned("_place", _ROW_BITS))
    starts = placed.groupBy(*groups, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset")
    keys = [*groups, "_range"]
    offsets = starts.select(*[F.col(c).alias(f"_of_{c}") for c in keys], offset)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return placed.join(offsets, same).select(*df.columns, (F.col("_place") + F.col("_offset")).alias("position"))


def with_chunk(df: DataFrame, size: int, groups: Sequence[str] = (), name: str = "chunk_id", **order) -> DataFrame:
    """Cut each group, in input order, into consecutive chunks of ``size`` rows.

    Adds the 0-based chunk number and the row's place in its chunk, ``ord``.
    """
    placed = with_position(df, groups, **order)
    return placed.select(
        *df.columns,
        F.floor(F.col("position") / size).cast("long").alias(name),
        F.pmod(F.col("position"), F.lit(size)).cast("int").alias("ord"),
    )
