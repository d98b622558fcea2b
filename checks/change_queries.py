"""Trees that change: deleted, moved and changed files, and links."""

from __future__ import annotations

from checks import fixtures as fx
from checks import reference_sql as ref
from checks.common import Queries, joined
from pixledger.operators import folders, tree_diff
from pixledger.operators import inventory as inv

#: The inventory some time later: in folders of every third user files are deleted, changed, moved and added.
LATER_SQL = """
WITH fated AS (SELECT *, CASE WHEN folder LIKE '%0' OR folder LIKE '%3' OR folder LIKE '%6' THEN file_id % 10 ELSE 9 END AS fate FROM inventory)
SELECT file_id, CASE WHEN fate = 2 THEN replace(folder, '/pictures/', '/pictures/sorted/') ELSE folder END AS folder, name,
       mtime, CASE WHEN fate = 1 THEN length + 1 ELSE length END AS length FROM fated WHERE fate <> 0
UNION ALL SELECT -1 - file_id, folder, concat('new', name), mtime, length + 7 FROM fated WHERE fate = 3
"""


def _both(spark, sf):
    before = fx.inventory(spark, sf).select("file_id", "folder", "name", "mtime", "length")
    before.createOrReplaceTempView("inventory")
    return before, spark.sql(LATER_SQL)


def deleted_files(spark, sf):
    """Deletes, moves, changes and additions between two listings."""
    return tree_diff.file_changes(*_both(spark, sf))


def applied_changes(spark, sf):
    """The catalog after the changes, as a full reading of the later tree would give it."""
    before, after = (inv.with_path(side) for side in _both(spark, sf))
    changes = tree_diff.file_changes(before, after)
    parsed = after.join(changes.where("change IN ('insert', 'update')").select("path"), "path", "left_semi")
    columns = ["path", "folder", "name", "mtime", "length"]
    return tree_diff.applied(before.select(columns), changes, parsed)


def folder_table_after(spark, sf):
    """The folder table after the changes, from the facts kept before and the changes alone."""
    before, after = _both(spark, sf)
    partials = folders.partials_after(folders.folder_partials(before), tree_diff.file_changes(before, after), after)
    return folders.folder_table_of(partials, "/").select("path", "parent", "has_children", joined("cover_images").alias("covers"), "mtime", "image_count")


def changed_folders(spark, sf):
    return tree_diff.changed_folders(*(tree_diff.folder_digests(side) for side in _both(spark, sf)))


_SIDES = f"""x AS (SELECT concat(folder, '/', name) AS path, folder, mtime, length FROM inventory),
y AS (SELECT concat(folder, '/', name) AS path, folder, mtime, length FROM ({LATER_SQL}))"""

CHANGES_SQL = f"""
WITH inventory AS ({fx.INVENTORY_SQL}), {_SIDES},
gone AS (SELECT * FROM x WHERE path NOT IN (SELECT path FROM y)), fresh AS (SELECT * FROM y WHERE path NOT IN (SELECT path FROM x)),
moves AS (SELECT g.path AS old_path, f.path, f.mtime, f.length FROM gone g JOIN fresh f USING (mtime, length)
    WHERE (SELECT count(*) FROM gone o WHERE o.mtime = g.mtime AND o.length = g.length) = 1
      AND (SELECT count(*) FROM fresh o WHERE o.mtime = f.mtime AND o.length = f.length) = 1)
SELECT 'move' AS change, path, old_path, mtime, length FROM moves
UNION ALL SELECT 'delete', path, NULL, mtime, length FROM gone WHERE path NOT IN (SELECT old_path FROM moves)
UNION ALL SELECT 'insert', path, NULL, mtime, length FROM fresh WHERE path NOT IN (SELECT path FROM moves)
UNION ALL SELECT 'update', path, NULL, y.mtime, y.length FROM x JOIN y USING (path) WHERE (x.mtime, x.length) <> (y.mtime, y.length)
"""

LATER_TABLE_SQL = f"""
WITH inventory AS ({fx.INVENTORY_SQL}), later AS ({LATER_SQL}),
above AS (SELECT *, unnest({ref.ANCESTORS}) AS path FROM later),
top AS (SELECT folder AS path, string_agg(concat(folder, '/', name), '|' ORDER BY mtime DESC, concat(folder, '/', name)) AS covers FROM (
    SELECT * FROM later WHERE {ref.IS_IMAGE} QUALIFY row_number() OVER (PARTITION BY folder ORDER BY mtime DESC, concat(folder, '/', name)) <= 3) GROUP BY folder)
SELECT path, CASE WHEN path = '/' THEN NULL WHEN regexp_matches(path, '^/[^/]+$') THEN '/' ELSE regexp_replace(path, '/[^/]+$', '') END AS parent,
  true AS has_children, coalesce(any_value(covers), '') AS covers, max(mtime) AS mtime, count(*) FILTER (WHERE folder = path AND {ref.VISIBLE}) AS image_count
FROM above LEFT JOIN top USING (path) GROUP BY path
"""

FOLDERS_SQL = f"""
WITH inventory AS ({fx.INVENTORY_SQL}), {_SIDES}
SELECT DISTINCT folder AS path FROM ((SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT SELECT * FROM x))
"""

#: Links beside every folder: to it, to that link, out of the root, back into it, and in a circle.
LINKS_SQL = """
SELECT concat(folder, '-near') AS path, folder AS target FROM folders
UNION ALL SELECT concat(folder, '-far'), concat(folder, '-near') FROM folders
UNION ALL SELECT concat(folder, '-out'), replace(folder, '/pictures/', '/else/') FROM folders
UNION ALL SELECT concat(replace(folder, '/pictures/', '/else/'), '/back'), concat(folder, '-far') FROM folders
UNION ALL SELECT concat(folder, '-round'), concat(folder, '-round/more') FROM folders
"""
_ASKED = """concat(folder, CASE file_id % 6 WHEN 0 THEN '/' WHEN 1 THEN '-near/' WHEN 2 THEN '-far/' WHEN 3 THEN '-out/'
    WHEN 4 THEN '-out/back/' ELSE '-round/' END, name)"""


def linked_paths(spark, sf):
    """Paths through links of every kind, resolved and held against the root."""
    files = fx.inventory(spark, sf)
    files.createOrReplaceTempView("inventory")
    files.select("folder").distinct().createOrReplaceTempView("folders")
    asked, links = spark.sql(f"SELECT file_id, {_ASKED} AS path FROM inventory"), spark.sql(LINKS_SQL)
    return inv.check_root(asked, "/pictures", links=links, keep_resolved=True).select("file_id", "path", "resolved", "error_type")


LINKED_SQL = fx.oracle(
    f"""SELECT file_id, {_ASKED} AS path,
      CASE WHEN file_id % 6 = 5 THEN NULL WHEN file_id % 6 = 3 THEN concat(replace(folder, '/pictures/', '/else/'), '/', name) ELSE concat(folder, '/', name) END AS resolved,
      CASE WHEN file_id % 6 IN (3, 5) THEN 'permission' END AS error_type FROM inventory""",
    inventory=True,
)

QUERIES: Queries = {
    "ST1_deleted_files": (deleted_files, CHANGES_SQL),
    "ST1_applied_changes": (applied_changes, fx.oracle(f"SELECT concat(folder, '/', name) AS path, folder, name, mtime, length FROM ({LATER_SQL})", inventory=True)),
    "A5_folder_table_after": (folder_table_after, LATER_TABLE_SQL),
    "ST1_changed_folders": (changed_folders, FOLDERS_SQL),
    "P3_linked_paths": (linked_paths, LINKED_SQL),
}
