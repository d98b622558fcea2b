"""From files to the metadata table, in batch or incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.functions import paths
from pixledger.operators.refresh import one_per_version, unparsed
from pixledger.operators.resolve import attach_sidecars, resolve_metadata
from pixledger.schemas import MAX_FILE_BYTES
from pixledger.sources import files as file_source
from pixledger.sources.stores import Stores, spark_listing, tasks_can_open
from pixledger.sources.tags import extract_tags


def file_metadata(files: DataFrame, sidecars: DataFrame, content: str | None = None, stores: Stores | None = None) -> DataFrame:
    """Metadata of image files (path, folder, name, mtime, length; read by path,
    or from ``content``) and their sidecars. Files over the byte limit are not opened."""
    small = F.col("length") <= MAX_FILE_BYTES
    tagged = extract_tags(files.where(small), content, stores=stores)
    large = files.where(~small)
    if content:
        large = large.drop(content)
    listed = tagged.unionByName(large, allowMissingColumns=True).withColumn("file_id", F.xxhash64("path"))
    return resolve_metadata(attach_sidecars(listed, sidecars))


def file_contents_metadata(listing: DataFrame, root: str) -> DataFrame:
    """Metadata of every visible image of a listing with contents (path, mtime, length, content)."""
    texts = file_source.sidecars(listing.where(F.endswith("path", F.lit(".txt"))))
    return file_metadata(file_source.list_inventory(listing, root), texts, "content")


def scan_metadata(spark: SparkSession, root: str, stores: Stores | None = None) -> DataFrame:
    """Metadata of every visible image below a root, and an error row for each
    folder that could not be listed.

    The tree is listed by tasks, once; of an image only its headers are read. A store that only
    Spark's own reader opens is listed and read by that, files whole.
    """
    if not tasks_can_open(root, stores):
        return file_contents_metadata(spark_listing(spark, root), root)
    entries = file_source.walk_tree(spark, root, stores)
    listing = file_source.files_of(entries)
    texts = file_source.sidecars(file_source.read_texts(listing, stores))
    found = file_metadata(file_source.list_inventory(listing, file_source.root_path(root)), texts, stores=stores)
    failed = file_source.errors_of(entries).select(
        F.xxhash64("path").alias("file_id"), paths.parent(F.col("path")).alias("folder"),
        paths.file_name(F.col("path")).alias("name"), "error_type",
        F.lit("The folder could not be listed").alias("error_message"),
    )
    return found.unionByName(failed, allowMissingColumns=True)


def new_metadata(files: DataFrame, done: DataFrame, parse=resolve_metadata) -> DataFrame:
    """Metadata of file states the catalog does not hold yet."""
    return parse(unparsed(one_per_version(files), done))
