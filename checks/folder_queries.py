"""Facts per folder and the folder tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import reference_sql as ref
from checks.common import Queries, joined
from pixledger.operators import folders
from pixledger.operators.inventory import visible_images


def image_count(spark, sf):
    return folders.image_counts(fx.inventory(spark, sf))


def total_images(spark, sf):
    """Each listed image's folder total, whatever page it is on."""
    return folders.total_images(visible_images(fx.inventory(spark, sf))).select("file_id", "total_images")


def has_children(spark, sf):
    return folders.has_children(fx.inventory(spark, sf))


def covers(spark, sf):
    return folders.covers(fx.inventory(spark, sf)).select("folder", joined("cover_images").alias("covers"))


def folder_table(spark, sf):
    return folders.folder_table(fx.inventory(spark, sf), "/").select(
        "path", "name", "parent", "has_children", joined("cover_images").alias("covers"), "mtime", "image_count"
    )


def folder_table_with_directories(spark, sf):
    """With a manifest of directories: their own times, and empty ones too."""
    files = fx.inventory(spark, sf)
    listed = files.select("folder").distinct()
    directories = listed.select("folder", F.expr("TIMESTAMP_NTZ'2025-01-01 00:00:00'").alias("mtime")).unionByName(
        listed.select(
            F.concat("folder", F.lit("/empty")).alias("folder"),
            F.expr("TIMESTAMP_NTZ'2025-02-02 00:00:00'").alias("mtime"),
        )
    )
    table = folders.folder_table(files, "/", directories)
    return table.where(F.col("path").contains("/user")).select("path", "has_children", "mtime", "image_count")


def scan_summary(spark, sf):
    table = folders.folder_table(fx.inventory(spark, sf), "/")
    loaded = table.select("path", F.lit(7).cast("bigint").alias("loaded_count")).where("path LIKE '%/click%'")
    return folders.scan_summary(table, loaded)


def child_folders(spark, sf):
    return folders.child_folders(folders.folder_table(fx.inventory(spark, sf), "/"))


def subtree_counts(spark, sf):
    return folders.subtree_counts(fx.inventory(spark, sf), "/")


def _in_store(inventory):
    """The same files in an object store, every fiftieth directly in its root."""
    return inventory.withColumn("folder", F.expr("IF(file_id % 50 = 0, 's3a://bucket', concat('s3a://bucket', folder))"))


def folder_table_urls(spark, sf):
    return folders.folder_table(_in_store(fx.inventory(spark, sf)), "/").select(
        "path", "name", "parent", "has_children", joined("cover_images").alias("covers"), "mtime", "image_count"
    )


def subtree_counts_urls(spark, sf):
    return folders.subtree_counts(_in_store(fx.inventory(spark, sf)), "/")


IN_STORE = """stored AS (SELECT * REPLACE (CASE WHEN file_id % 50 = 0 THEN '' ELSE folder END AS folder) FROM inventory),
places AS (SELECT *, unnest(list_transform(range(1, len(string_split(folder, '/')) + 1),
    lambda i: concat('s3a://bucket', array_to_string(string_split(folder, '/')[1:i], '/')))) AS path FROM stored)"""
NODES = f"""spread AS (SELECT folder, name, mtime, unnest({ref.ANCESTORS}) AS path FROM inventory),
tree AS (SELECT path, regexp_extract(path, '[^/]+$') AS name,
    CASE path WHEN '/' THEN NULL WHEN '/pictures' THEN '/' ELSE regexp_replace(path, '/[^/]+$', '') END AS parent,
    max(mtime) AS mtime, count(*) FILTER (WHERE path = folder AND {ref.VISIBLE}) AS image_count
    FROM spread GROUP BY path)"""
COVERS = f"""covers AS (SELECT folder, string_agg(concat(folder, '/', name), '|' ORDER BY mtime DESC, name) AS covers
    FROM (SELECT * FROM inventory WHERE {ref.IS_IMAGE}
      QUALIFY row_number() OVER (PARTITION BY folder ORDER BY mtime DESC, name) <= 3) GROUP BY folder)"""
INV = dict(inventory=True)
QUERIES: Queries = {
    "A1_image_count": (
        image_count,
        fx.oracle(
            f"SELECT folder, count(*) FILTER (WHERE {ref.VISIBLE}) AS image_count FROM inventory GROUP BY folder", **INV
        ),
    ),
    "A2_total_images": (
        total_images,
        fx.oracle(
            f"SELECT file_id, count(*) OVER (PARTITION BY folder) AS total_images FROM inventory WHERE {ref.VISIBLE}",
            **INV,
        ),
    ),
    "A3_has_children": (
        has_children,
        fx.oracle("SELECT DISTINCT folder, true AS has_children FROM inventory", **INV),
    ),
    "A4_covers": (covers, fx.oracle("SELECT * FROM covers", ctes=COVERS, **INV)),
    "A5_folder_table": (
        folder_table,
        fx.oracle(
            """SELECT path, name, parent, true AS has_children, coalesce(covers, '') AS covers, mtime, image_count
            FROM tree LEFT JOIN covers ON path = folder""",
            ctes=f"{NODES}, {COVERS}",
            **INV,
        ),
    ),
    "A5_folder_table_with_directories": (
        folder_table_with_directories,
        fx.oracle(
            """SELECT path, true AS has_children, TIMESTAMP '2025-01-01' AS mtime, image_count FROM tree
              WHERE contains(path, '/user')
            UNION ALL SELECT DISTINCT concat(folder, '/empty'), false, TIMESTAMP '2025-02-02', 0 FROM inventory""",
            ctes=NODES,
            **INV,
        ),
    ),
    "A6_scan_summary": (
        scan_summary,
        fx.oracle(
            """SELECT n.path, coalesce(a.album_count, 0) AS album_count,
              CASE WHEN image_count > 0 THEN image_count WHEN n.path LIKE '%/click%' THEN 7 ELSE 0 END AS image_count
            FROM tree n LEFT JOIN (SELECT parent AS path, count(*) AS album_count FROM tree GROUP BY ALL) a USING (path)""",
            ctes=NODES,
            **INV,
        ),
    ),
    "J6_child_folders": (
        child_folders,
        fx.oracle(
            """SELECT p.path, p.image_count, c.path AS child_path, c.name AS child_name,
              c.image_count AS child_image_count FROM tree p JOIN tree c ON c.parent = p.path""",
            ctes=NODES,
            **INV,
        ),
    ),
    "A5_folder_table_urls": (
        folder_table_urls,
        fx.oracle(
            f"""SELECT p.path, regexp_extract(p.path, '[^/]+$') AS name,
              CASE WHEN p.path <> 's3a://bucket' THEN regexp_replace(p.path, '/[^/]+$', '') END AS parent,
              true AS has_children, coalesce(any_value(c.covers), '') AS covers, max(p.mtime) AS mtime,
              count(*) FILTER (WHERE p.path = concat('s3a://bucket', p.folder) AND {ref.VISIBLE}) AS image_count
            FROM places p LEFT JOIN (
              SELECT concat('s3a://bucket', folder) AS path,
                string_agg(concat('s3a://bucket', folder, '/', name), '|' ORDER BY mtime DESC, name) AS covers
              FROM (SELECT * FROM stored WHERE {ref.IS_IMAGE}
                QUALIFY row_number() OVER (PARTITION BY folder ORDER BY mtime DESC, name) <= 3) GROUP BY folder) c
              ON c.path = p.path GROUP BY p.path""",
            ctes=IN_STORE,
            **INV,
        ),
    ),
    "L4_subtree_counts_urls": (
        subtree_counts_urls,
        fx.oracle(f"SELECT path, count(*) FILTER (WHERE {ref.VISIBLE}) AS image_count FROM places GROUP BY path", ctes=IN_STORE, **INV),
    ),
    "L4_subtree_counts": (
        subtree_counts,
        fx.oracle(
            f"SELECT path, count(*) FILTER (WHERE {ref.VISIBLE}) AS image_count FROM spread GROUP BY path",
            ctes=NODES,
            **INV,
        ),
    ),
}
