"""Trees that change between listings, and the bucketed version keys of the stream."""

import random

from pyspark.sql import functions as F

from pixledger.operators import tree_diff
from pixledger.operators.inventory import with_path
from pixledger.streaming import versions
from pixledger.streaming.refresh import refresh_stream

INVENTORY = "folder string, name string, mtime int, length long"


def listed(spark, rows):
    return spark.createDataFrame(rows, INVENTORY)


def expected(before, after):
    was, now = ({f"{r[0]}/{r[1]}": r[2:] for r in rows} for rows in (before, after))
    gone, new = ({p: v for p, v in a.items() if p not in b} for a, b in ((was, now), (now, was)))
    only = lambda side: {v: p for p, v in side.items() if list(side.values()).count(v) == 1}
    moves = {p: only(gone)[v] for v, p in only(new).items() if v in only(gone)}
    rows = [("move", p, old, *now[p]) for p, old in moves.items()]
    rows += [("delete", p, None, *v) for p, v in gone.items() if p not in moves.values()]
    rows += [("insert", p, None, *v) for p, v in new.items() if p not in moves]
    return sorted(rows + [("update", p, None, *now[p]) for p in now if p in was and was[p] != now[p]], key=repr)


def random_tree(rng, n):
    return {(f"/r{'/d%d' % rng.randrange(4) * rng.randrange(4)}", f"f{k}"): (rng.randrange(60), rng.randrange(5)) for k in range(n)}


def test_changes_between_random_trees(spark):
    rng = random.Random(4)
    for turn in range(3):
        before = random_tree(rng, 120)
        after = dict(before)
        for key in rng.sample(sorted(before), 12 * turn):
            version = after.pop(key)
            fate = rng.randrange(4)
            if fate == 1:
                after[key] = (version[0] + 1, version[1])
            elif fate == 2:
                after[f"/r/new{rng.randrange(3)}", key[1]] = version
            elif fate == 3:
                after["/r", f"copy{key[1]}"] = version
        rows = [[(*k, *v) for k, v in side.items()] for side in (before, after)]
        sides = [listed(spark, r) for r in rows]
        changes = tree_diff.file_changes(*sides)
        assert sorted(map(tuple, changes.collect()), key=repr) == expected(*rows)
        catalog, later = (with_path(side) for side in sides)
        parsed = later.join(changes.where("change IN ('insert', 'update')").select("path"), "path", "left_semi")
        assert sorted(tree_diff.applied(catalog, changes, parsed).select(*later.columns).collect()) == sorted(later.collect())


def test_empty_sides(spark):
    none, some = listed(spark, []), listed(spark, [("/r/a", "x", 1, 2)])
    assert tree_diff.file_changes(none, none).collect() == []
    assert [tuple(r) for r in tree_diff.file_changes(none, some).collect()] == [("insert", "/r/a/x", None, 1, 2)]
    assert [tuple(r) for r in tree_diff.file_changes(some, none).collect()] == [("delete", "/r/a/x", None, 1, 2)]


def test_digests_combine_and_only_changed_levels_are_read(spark, tmp_path):
    rows = [(f"/r/{k % 5}/{k % 7}", f"f{k}", k, k) for k in range(200)]
    before, after = listed(spark, rows), listed(spark, rows[:-1] + [("/r/4/3", "f199", 0, 199)])
    whole = {r.path: tuple(r[c] for c in tree_diff.DIGEST) for r in tree_diff.folder_digests(before).collect()}
    parts = [{r.path: [r[c] for c in tree_diff.DIGEST] for r in tree_diff.folder_digests(before.where(f"length % 2 = {k}")).collect()} for k in (0, 1)]
    none = [0, 0, 0]
    assert whole == {p: (parts[0].get(p, none)[0] + parts[1].get(p, none)[0], *(parts[0].get(p, none)[i] ^ parts[1].get(p, none)[i] for i in (1, 2))) for p in whole}
    for name, side in (("before", before), ("after", after)):
        tree_diff.write_digests(side, str(tmp_path / name))
    kept = [spark.read.parquet(str(tmp_path / name)) for name in ("before", "after")]
    assert [r.path for r in tree_diff.changed_folders(*kept).collect()] == ["/r/4/3"]
    assert tree_diff.changed_folders(kept[0], kept[0]).collect() == []


def keys(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("/f/"), "id").alias("path"), F.lit(1).alias("mtime"), F.col("id").alias("length"))


def test_a_batch_reads_the_buckets_of_its_own_paths(spark, tmp_path):
    catalog = str(tmp_path / "catalog")
    assert versions.known_versions(keys(spark, 0, 3), catalog, "q", 0, 64) is None
    for batch, (first, last) in enumerate(((0, 1000), (1000, 4000))):
        versions.add_versions(keys(spark, first, last), catalog, "q", batch, 64)
    asked = keys(spark, 10, 13)
    found = versions.known_versions(asked, catalog, "q", 9, 64)
    assert found.count() < 4000 * 3 / 64 * 2  # three buckets of 64
    assert asked.join(found, ["path", "mtime", "length"], "left_anti").isEmpty()
    assert len({p.split("/bucket=")[1].split("/")[0] for p in found.inputFiles()}) <= 3
    # A batch that runs again does not count its own keys.
    assert versions.known_versions(asked, catalog, "q", 0, 64).where("length < 1000").isEmpty()
    versions.add_versions(keys(spark, 0, 1000), catalog, "q", 0, 64)
    versions.compact_versions(spark, catalog, 1)
    rows = spark.read.parquet(f"{catalog}/{versions.FOLDER}")
    assert rows.count() == 4000 == rows.select("path").distinct().count()


def test_keys_lost_between_data_and_keys_come_back(spark, tmp_path):
    import shutil

    source, catalog = str(tmp_path / "in"), str(tmp_path / "catalog")
    keys(spark, 0, 50).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(source)
        refresh_stream(stream, lambda batch: batch, catalog, str(tmp_path / checkpoint), buckets=8).awaitTermination()
        return spark.read.parquet(catalog).count()

    assert run("one") == 50
    shutil.rmtree(f"{catalog}/{versions.FOLDER}")
    assert run("two") == 50
    assert spark.read.parquet(f"{catalog}/{versions.FOLDER}").count() == 50
