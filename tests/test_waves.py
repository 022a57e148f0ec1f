import os
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lumenframe.functions.shared import shared_dir
from lumenframe.plans import queries
from lumenframe.sources import files


def test_folders_are_written_in_waves(spark):
    """All files are listed, whole folders at a time, and no earlier wave is on disk when one is listed."""
    rows = spark.range(120).select(F.concat(F.lit("c"), (F.col("id") % 24).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.lit(b"12").alias("content"))
    seen = []

    def after(root):
        here = [os.path.join(at, n) for at, _, names in os.walk(os.path.dirname(root)) for n in names if n.startswith("f")]
        seen.append(len(here))
        assert all(x.startswith(f"{root}/") for x in here)
        return files.listing(spark, root=root).select(F.substring_index("folder", "/", -1).alias("folder"), "name", "length")

    found = queries._in_folder(spark, rows, after, wave=30).collect()
    assert sorted((r.folder, r.name, r.length) for r in found) == sorted((f"c{i % 24}", f"f{i}", 2) for i in range(120))
    assert len(seen) == 4 and sum(seen) == 120 and max(seen) < 120
    assert not [x for x in os.listdir(shared_dir(spark)) if x.startswith("files-")]


@pytest.mark.parametrize("wave", [1000, 30])
def test_a_wave_is_written_by_all_cores_folder_by_folder(spark, monkeypatch, wave):
    """However few tasks the rows come in, and all waves below one root."""
    rows = spark.range(120).select(F.concat(F.lit("c"), (F.col("id") % 24).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.lit(b"12").alias("content")).coalesce(1)
    roots, seen, drop = set(), [], files.drop

    def kept(due, root):
        roots.add(root)
        parts = due.select(F.substring_index("path", "/", 1).alias("folder")).rdd.glom().collect()
        assert len(parts) == spark.sparkContext.defaultParallelism
        seen.extend(folder for part in parts for folder, _ in groupby(r.folder for r in part))
        return drop(due, root)

    monkeypatch.setattr(files, "drop", kept)
    assert queries._in_folder(spark, rows, lambda root: files.listing(spark, root=root).select("name"), wave=wave).count() == 120
    assert sorted(seen) == sorted(f"c{i}" for i in range(24)) and len(roots) == 1


def test_a_folder_larger_than_a_wave(spark):
    """Leaves waves without files."""
    rows = spark.range(100).select(F.concat(F.lit("c/f"), F.col("id").cast("string")).alias("path"), F.lit(b"12").alias("content"))
    assert queries._in_folder(spark, rows, lambda root: files.listing(spark, root=root).select("name"), wave=30).count() == 100


def test_contents_are_read_where_they_are_listed(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x").write_bytes(b"\x00" * i)
    found = files.contents(files.listing(spark, root=str(tmp_path))).collect()
    assert sorted((r.path[-4:], bytes(r.content)) for r in found) == [(f"d{i}/x", b"\x00" * i) for i in range(3)]
    files.remove(spark, str(tmp_path))
    assert not tmp_path.exists()


def test_mask_listing_writes_on_all_cores(spark, monkeypatch):
    """Its table comes as one task; a wave of it does not, and the other names are left out after they are written."""
    written, drop = [], files.drop

    def kept(due, root):
        written.append([len(part) for part in due.select("path").rdd.glom().collect()])
        return drop(due, root)

    monkeypatch.setattr(files, "drop", kept)
    found = queries.QUERIES["mask_listing"](spark, "/root/testdata/sf0.001")
    assert 0 < found.count() < sum(written[0]) and all(r.name.endswith(".mat") for r in found.collect())
    assert len(written) == 1 and sum(n > 0 for n in written[0]) == spark.sparkContext.defaultParallelism
