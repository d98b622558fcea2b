"""Keeping long row-local computations in one place in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compile_methods() -> None:
    """Let the session run operators one by one where a fused method would be too long to compile.

    The JVM leaves methods beyond 8,000 bytes of code to its interpreter; the
    parsers' long projections would otherwise end there. Results do not hang on it.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and int(spark.conf.get(METHOD_LIMIT)) > 8000:
        spark.conf.set(METHOD_LIMIT, "8000")


def finish(df: DataFrame, *names: str, drop: tuple[str, ...], settled: bool) -> DataFrame:
    """``settle``, or only leave ``drop`` behind where a later stage settles the row."""
    return settle(df, *names, drop=drop) if settled else df.drop(*drop)


def settle(df: DataFrame, *names: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Compute the named columns here, whatever is filtered on later, and leave
    the columns in ``drop`` behind.

    A filter on a computed column is pushed below its projection by copying the
    expression into the filter. Over the staged parsers that multiplies the work
    and can swell the plan without bound. Filters do not pass a generator whose
    output they use, so the columns go through a one-element explode; filters on
    all other columns still reach the scan.
    """
    others = [c for c in df.columns if c not in names and c not in drop]
    packed = df.select(*others, F.explode_outer(F.array(F.struct(*names))).alias("_settled"))
    return packed.select(*others, *[F.col("_settled")[name].alias(name) for name in names])
