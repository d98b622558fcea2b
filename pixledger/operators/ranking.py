"""Positions, totals and neighbours inside groups of any size.

``row_number() over (partition by folder ...)`` sends a whole folder to one
task, which fails once a folder holds a large share of the catalog. Here rows
are first cut into ranges of near-equal size along the full order (group, then
sort keys, then a unique tie-break), so that a large folder spans many ranges
and small folders share one:

1. Splitters are taken from a hash sample of the keys. The sample is chosen by
   a hash of the tie-break column, so every evaluation of the plan sees the same
   ranges, and its size depends on the number of ranges, not on the data.
2. Each row finds its range by binary search in the splitters.
3. One aggregate per (group, range) gives sizes and edge rows; a running sum over
   the few ranges of a group turns them into offsets.
4. Row numbers are taken per (group, range) and the offset added.

The result equals the plain window's exactly. All keys ascend; see
``functions.text.reversed_key`` and negated numbers for descending orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SAMPLE_PER_RANGE = 16
_HASH_SPACE = 1 << 30


def range_count(df: DataFrame) -> int:
    """Ranges to cut into: a few per shuffle partition, so hashing evens them out."""
    return max(8, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_range(df: DataFrame, keys: list[str], tie: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: the number of splitters at or before the row.

    ``keys`` are non-null columns that together order the rows; ``tie`` is the
    one among them that is unique enough to sample by.
    """
    ranges = ranges or range_count(df)
    row = F.struct(*keys)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.pmod(F.xxhash64(tie), F.lit(_HASH_SPACE)) / F.lit(float(_HASH_SPACE))
    splitters = (
        df.where(share * total < F.lit(float(ranges * _SAMPLE_PER_RANGE)))
        .agg(F.sort_array(F.collect_list(row)).alias("s"))
        .select(F.filter("s", lambda _, i: i % _SAMPLE_PER_RANGE == _SAMPLE_PER_RANGE - 1).alias("s"))
    )
    # Steps for up to twice the expected number of splitters.
    steps = [1 << bit for bit in range((2 * ranges).bit_length(), -1, -1)]
    def search(row: Column) -> Column:
        return F.aggregate(
            F.array(*[F.lit(step) for step in steps]),
            F.lit(0),
            lambda pos, step: F.when(
                F.get(F.col("_splitters"), pos + step - 1) <= row, pos + step
            ).otherwise(pos),
        )

    # The row's keys are bound once, or each step of the search would build them
    # anew. The subquery is its own column because lambdas may not name one; the
    # optimizer folds it back in, so the array is never copied into rows.
    return df.withColumn("_splitters", splitters.scalar()).select(
        *df.columns, F.get(F.transform(F.array(row), search), 0).alias("_range")
    )


def with_positions(
    df: DataFrame,
    group: list[str],
    order: list[str],
    tie: str,
    neighbours_of: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``position`` (from 1) and ``total`` within the group; with
    ``neighbours_of`` also ``previous`` and ``next`` of that column."""
    ordering = [*order, tie]
    ranged = with_range(df, [*group, *ordering], tie, ranges)
    aggregates = [F.count(F.lit(1)).alias("_size")]
    if neighbours_of:
        edge = F.struct(*ordering, F.col(neighbours_of).alias("_n"))
        aggregates += [F.min(edge).alias("_low"), F.max(edge).alias("_high")]
    over_group = Window.partitionBy(*group).orderBy("_range")
    offsets = [
        (F.sum("_size").over(over_group) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(*group)).alias("total"),
    ]
    if neighbours_of:
        offsets += [
            F.lag("_high").over(over_group)["_n"].alias("_before"),
            F.lead("_low").over(over_group)["_n"].alias("_after"),
        ]
    pieces = ranged.groupBy(*group, "_range").agg(*aggregates).select(*group, "_range", *offsets)
    inside = Window.partitionBy(*group, "_range").orderBy(*ordering)
    added = [(F.row_number().over(inside) + F.col("_offset")).cast("bigint").alias("position"), "total"]
    if neighbours_of:
        added += [
            F.coalesce(F.lag(neighbours_of).over(inside), "_before").alias("previous"),
            F.coalesce(F.lead(neighbours_of).over(inside), "_after").alias("next"),
        ]
    return ranged.join(pieces, [*group, "_range"]).select(*df.columns, *added)
