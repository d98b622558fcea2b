"""Facts per folder: counts, newest covers, subtree totals, the tree's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixledger.functions import paths
from pixledger.schemas import COVER_COUNT
from pixledger.session import stored


def _image() -> F.Column:
    return paths.is_image(F.col("name"))


def _visible_image() -> F.Column:
    return ~paths.is_hidden(F.col("name")) & _image()


def image_counts(inventory: DataFrame) -> DataFrame:
    """Direct visible images per folder; folders without any show 0."""
    return inventory.groupBy("folder").agg(F.count_if(_visible_image()).alias("image_count"))


def total_images(images: DataFrame) -> DataFrame:
    """Add each listed image's folder total, whatever page it is on; counted per folder first, so that no folder meets in one task."""
    totals = images.groupBy("folder").agg(F.count(F.lit(1)).alias("total_images"))
    return images.join(totals, "folder")


def has_children(inventory: DataFrame) -> DataFrame:
    """Whether a folder holds any entry at all, hidden ones and non-images included."""
    return inventory.groupBy("folder").agg((F.count(F.lit(1)) > 0).alias("has_children"))


def covers(inventory: DataFrame, n: int = COVER_COUNT) -> DataFrame:
    """Paths of the newest n images per folder, newest first, hidden ones included.

    The rank filter lets Spark keep n rows per folder on the map side already, so
    a huge folder shuffles n rows per task.
    """
    return _newest_images(inventory, n).select("folder", F.col("_ranked.path").alias("cover_images"))


def _newest_images(inventory: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("folder").orderBy(F.col("mtime").desc(), "path")
    return (
        inventory.where(_image())
        .select("folder", "mtime", paths.join(F.col("folder"), F.col("name")).alias("path"))
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= n)
        .groupBy("folder")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "mtime", "path"))).alias("_ranked"))
    )


def folder_nodes(inventory: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """One row per folder that holds files, at any depth, or is a known directory.

    Columns: path, image_count, has_children, mtime. ``directories`` (folder,
    mtime) adds empty folders and a folder's own time; without it a folder's time
    is the newest below it. Files are aggregated per folder first, so only
    per-folder rows are spread over their ancestors.
    """
    return _spread(_own_facts(inventory), directories)


def _own_facts(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("folder").agg(
        F.count_if(_visible_image()).alias("images"),
        F.count(F.lit(1)).alias("entries"),
        F.max("mtime").alias("newest"),
    )


def _spread(per_folder: DataFrame, directories: DataFrame | None) -> DataFrame:
    per_folder = per_folder.withColumn("own_time", F.lit(None).cast("timestamp_ntz"))
    if directories is not None:
        per_folder = per_folder.unionByName(
            directories.select(
                "folder",
                F.lit(0).cast("bigint").alias("images"),
                F.lit(0).cast("bigint").alias("entries"),
                F.lit(None).cast("timestamp_ntz").alias("newest"),
                F.col("mtime").cast("timestamp_ntz").alias("own_time"),
            )
        )
    spread = per_folder.select("*", F.explode(paths.ancestors(F.col("folder"))).alias("path"))
    own = F.col("path") == F.col("folder")
    return spread.groupBy("path").agg(
        F.sum(F.when(own, F.col("images")).otherwise(0)).alias("image_count"),
        F.max(~own | (F.col("entries") > 0)).alias("has_children"),
        F.coalesce(F.max(F.when(own, F.col("own_time"))), F.max("newest")).alias("mtime"),
    )


def folder_table(inventory: DataFrame, root: str, directories: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """The folder listing: name, path, parent, has_children, covers, mtime, count.

    Folders are listed up to the file system's or store's root, whose parent is
    NULL. What lies in a hidden folder below ``root`` is not listed; ``/`` as the root
    hides by every folder's name. ``links`` (path, target) adds a row for each link to a listed
    folder: named as the link, in the link's folder, with the target's path and facts.
    """
    shown = inventory.where(~paths.in_hidden(F.col("folder"), root))
    return _table(_own_facts(shown), covers(inventory), root, directories, links)


def folder_table_of(partials: DataFrame, root: str, directories: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """``folder_table`` from kept facts per folder (``folder_partials``), without the files."""
    top = partials.select("folder", F.col("covers.path").alias("cover_images"))
    shown = partials.where(~paths.in_hidden(F.col("folder"), root)).select("folder", "images", "entries", "newest")
    return _table(shown, top, root, directories, links)


def _table(per_folder: DataFrame, top: DataFrame, root: str, directories: DataFrame | None, links: DataFrame | None) -> DataFrame:
    table = (
        _spread(per_folder, directories)
        .join(top.withColumnRenamed("folder", "path"), "path", "left")
        .select(
            paths.file_name(F.col("path")).alias("name"),
            "path",
            F.nullif(paths.parent(F.col("path")), F.col("path")).alias("parent"),
            "has_children",
            F.coalesce("cover_images", F.array().cast("array<string>")).alias("cover_images"),
            "mtime",
            "image_count",
        )
        .where(~paths.in_hidden(F.col("path"), root))
    )
    return table if links is None else table.unionByName(linked_folders(table, links.where(~paths.in_hidden(F.col("path"), root))))


def linked_folders(folders: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of a folder table that links (path, target) lead to, named and placed as the links."""
    at = links.select(F.col("path").alias("_link"), F.col("target").alias("path"))
    return folders.join(at, "path").withColumns({"name": paths.file_name(F.col("_link")), "parent": paths.parent(F.col("_link"))}).select(*folders.columns)


def subtree_counts(inventory: DataFrame, root: str) -> DataFrame:
    """Visible images in and below every folder up to the root; hidden folders below ``root`` are left out."""
    return (
        image_counts(inventory.where(~paths.in_hidden(F.col("folder"), root)))
        .select("image_count", F.explode(paths.ancestors(F.col("folder"))).alias("path"))
        .groupBy("path")
        .agg(F.sum("image_count").alias("image_count"))
    )


def child_folders(folders: DataFrame) -> DataFrame:
    """Each folder with its direct child folders, as the tree view expands them.

    A parent appears once on its side, so a parent with very many children skews
    only the child side; that side is what AQE may split in an inner join.
    """
    child = folders.select(
        F.col("parent").alias("path"),
        F.col("path").alias("child_path"),
        F.col("name").alias("child_name"),
        F.col("image_count").alias("child_image_count"),
    )
    return folders.select("path", "image_count").join(child, "path")


def scan_summary(folders: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Per folder: direct sub-folders, and its images, or the number of ``loaded``
    rows (path, loaded_count) where the total is 0."""
    albums = folders.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("album_count"))
    rows = folders.select("path", "image_count").join(albums, "path", "left")
    images = F.col("image_count")
    if loaded is not None:
        rows = rows.join(loaded, "path", "left")
        images = F.when(images == 0, F.coalesce("loaded_count", F.lit(0))).otherwise(images)
    return rows.select(
        "path", F.coalesce("album_count", F.lit(0)).alias("album_count"), images.alias("image_count")
    )


_COVER = "array<struct<mtime:timestamp_ntz,path:string>>"


def _as_covers(ranked: F.Column) -> F.Column:
    return F.transform(ranked, lambda r: F.struct(r["mtime"].alias("mtime"), r["path"].alias("path")))


def folder_partials(inventory: DataFrame, n: int = COVER_COUNT) -> DataFrame:
    """Facts to keep per folder that holds files: entries, visible images, newest time, and the n newest images (mtime, path)."""
    top = _newest_images(inventory, n).select("folder", _as_covers(F.col("_ranked")).alias("covers"))
    return _own_facts(inventory).join(top, "folder", "left").withColumn("covers", F.coalesce("covers", F.array().cast(_COVER)))


def partials_after(partials: DataFrame, changes: DataFrame, inventory: DataFrame, n: int = COVER_COUNT) -> DataFrame:
    """``folder_partials`` of the later ``inventory``, from the earlier ones and the ``changes`` between (``tree_diff.file_changes``).

    Counts add and subtract. New files merge into a folder's newest time and images. Only where a file has left that
    may have been among these are the folder's files read again, of those folders alone.
    """
    change = F.col("change")
    at = lambda path, sign: F.struct(path.alias("path"), F.lit(sign).alias("sign"))
    sides = (
        F.when(change == "insert", F.array(at(F.col("path"), 1)))
        .when(change == "delete", F.array(at(F.col("path"), -1)))
        .when(change == "move", F.array(at(F.col("old_path"), -1), at(F.col("path"), 1)))
        .otherwise(F.array(at(F.col("path"), 0)))
    )
    rows = changes.select("mtime", F.explode(sides).alias("s")).select(
        "mtime", "s.sign", "s.path", paths.parent(F.col("s.path")).alias("folder"), paths.file_name(F.col("s.path")).alias("name")
    )
    there = F.col("sign") >= 0
    delta = rows.groupBy("folder").agg(
        F.sum("sign").cast("bigint").alias("d_entries"),
        F.sum(F.when(_visible_image(), F.col("sign")).otherwise(0)).cast("bigint").alias("d_images"),
        F.max(F.when(there, F.col("mtime"))).alias("d_newest"),
    )
    added = _newest_images(rows.where(there), n).select("folder", _as_covers(F.col("_ranked")).alias("d_covers"))
    delta = delta.join(added, "folder", "left")

    # An updated file's earlier time is not known: it may have been the newest unless its new one is.
    lost = F.array_contains("covers.path", F.col("path")) | F.when(F.col("sign") < 0, F.col("mtime") >= F.col("newest")).otherwise(F.col("mtime") < F.col("newest"))
    again = rows.where("sign < 1").join(partials.select("folder", "covers", "newest"), "folder").where(F.coalesce(lost, F.lit(True))).select("folder").distinct()
    again = stored(again, "again")
    renewed = folder_partials(inventory.join(again, "folder", "left_semi"), n)

    kept = partials.join(again, "folder", "left_anti").join(delta.join(again, "folder", "left_anti"), "folder", "full")
    none = F.array().cast(_COVER)
    # Newest first, equal times by path.
    order = lambda a, b: F.when(a["mtime"] > b["mtime"], -1).when(a["mtime"] < b["mtime"], 1).when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)
    merged = F.slice(F.array_sort(F.concat(F.coalesce("covers", none), F.coalesce("d_covers", none)), order), 1, n)
    count = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c)
    kept = kept.select("folder", count("images"), count("entries"), F.greatest("newest", "d_newest").alias("newest"), merged.alias("covers")).where("entries > 0")
    return kept.unionByName(renewed)
