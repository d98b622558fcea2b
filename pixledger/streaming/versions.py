"""The version keys of a catalog, by buckets of the path's hash.

A batch of new files asks only for the buckets its paths fall into, by their folders' names, so neither
the other buckets nor the catalog itself are listed or read. Keys lie beside the catalog's data in a folder
that Spark leaves out when it reads the catalog.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.operators.refresh import VERSION_KEY
from pixledger.session import stored

QUERY, BATCH, BUCKET = "query", "batch", "bucket"
FOLDER = "_versions"
#: A batch writes a file into each bucket it touches; 10**9 files give four million keys a bucket.
BUCKETS = 256


def bucketed(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return files.withColumn(BUCKET, F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))


def _read(spark: SparkSession, base: str, *folders: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", base).parquet(*folders)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def known_versions(files: DataFrame, catalog: str, query: str, batch: int, buckets: int = BUCKETS) -> DataFrame | None:
    """The keys in the buckets of ``files``, but for those of one batch of one query; None if there are none.

    The bucket numbers that reach the driver are ``buckets`` at most.
    """
    spark = files.sparkSession
    base = f"{catalog}/{FOLDER}"
    asked = sorted(r[0] for r in bucketed(files.select("path"), buckets).select(BUCKET).distinct().collect())
    there = [f"{base}/{BUCKET}={b}" for b in asked if _exists(spark, f"{base}/{BUCKET}={b}")]
    if not there:
        return None
    rows = _read(spark, base, *there)
    return rows.where((F.col(QUERY) != query) | (F.col(BATCH) != batch)).select(BUCKET, *VERSION_KEY)


def add_versions(parsed: DataFrame, catalog: str, query: str, batch: int, buckets: int = BUCKETS) -> None:
    """Keep the keys of a batch that the catalog now holds; a batch that runs again may add its own keys again."""
    keys = bucketed(parsed.select(*VERSION_KEY), buckets).withColumns({QUERY: F.lit(query), BATCH: F.lit(batch).cast("bigint")})
    keys.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{catalog}/{FOLDER}")


def complete_versions(spark: SparkSession, catalog: str, buckets: int = BUCKETS) -> None:
    """Add the keys of batches that the catalog holds without: older catalogs, or a stop between data and keys.

    Reads the whole catalog's keys; a stream does so once, when it starts.
    """
    rows = _read(spark, catalog, catalog)
    if rows is None:
        return
    kept = _read(spark, f"{catalog}/{FOLDER}", f"{catalog}/{FOLDER}")
    rows = rows.select(*VERSION_KEY, QUERY, F.col(BATCH).cast("bigint").alias(BATCH))
    if kept is not None:
        rows = rows.join(kept.select(QUERY, BATCH).distinct(), [QUERY, BATCH], "left_anti")
    if rows.isEmpty():
        return
    bucketed(rows, buckets).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{catalog}/{FOLDER}")


def compact_versions(spark: SparkSession, catalog: str, most_files: int = 16) -> None:
    """Write the keys of buckets that have grown to more than ``most_files`` files anew, one file each; not while a stream runs."""
    base = f"{catalog}/{FOLDER}"
    rows = _read(spark, base, base)
    if rows is None:
        return
    many = rows.select(BUCKET, F.input_file_name().alias("file")).distinct().groupBy(BUCKET).count().where(F.col("count") > most_files)
    asked = [r[0] for r in many.collect()]  # bucket numbers
    if asked:
        merged = stored(rows.where(F.col(BUCKET).isin(asked)).distinct().repartition(BUCKET), "versions")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(base)
