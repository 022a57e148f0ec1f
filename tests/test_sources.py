import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import catalog, volume
from lumenframe.sources import files
from lumenframe.sources.files import FolderListing, mask_files


def test_folder_listing(spark, tmp_path):
    for name in ("a.dcm", "_b.dcm", ".c.dcm", "x.mat"):
        (tmp_path / name).write_bytes(b"12")
    (tmp_path / "sub").mkdir()
    (tmp_path / "a,b").mkdir()
    (tmp_path / "a,b" / "e.dcm").touch()
    (tmp_path / "sub" / "d.dcm").touch()
    spark.dataSource.register(FolderListing)
    df = spark.read.format("folder_listing").option("folders", json.dumps([str(tmp_path), f"{tmp_path}/none", f"{tmp_path}/a,b"])).load()
    assert [r.name for r in df.orderBy("path").collect()] == ["_b.dcm", "e.dcm", "a.dcm", "x.mat"]


def test_mask_files(spark, tmp_path):
    (tmp_path / "x.mat").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"1")
    assert [r.path.split("/")[-1] for r in mask_files(spark, str(tmp_path)).collect()] == ["x.mat"]
    assert mask_files(spark, str(tmp_path / "none")).count() == mask_files(spark, "").count() == 0


def test_decoder_failures_are_rows(spark):
    df = spark.createDataFrame([("a", bytearray(b"k=v")), ("b", bytearray(b"!"))], "path string, content binary")
    decode = lambda b: dict([b.decode().split("=")])
    found = {r.path: (r.keyword, r.value, r.error is None) for r in catalog.header_rows(df, decode).collect()}
    assert found == {"a": ("k", "v", True), "b": (None, None, False)}


def test_volume_write(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, 0, [1.0]), (2, 0, 0, [2.0])], "series_id int, k int, j int, vals array<double>")
    volume.write(lines, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).filter("series_id = 2").collect()[0].vals == [2.0]


def test_pushed_filters_leave_out_folders_and_files(spark, tmp_path):
    for folder in "abc":
        (tmp_path / folder).mkdir()
        for name in ("x.mat", "y.dcm"):
            (tmp_path / folder / name).touch()
    reader = files.PushedReader({"root": str(tmp_path)})
    pushed = [files.EqualTo(("folder",), f"{tmp_path}/b"), files.StringEndsWith(("name",), ".mat"), files.EqualTo(("length",), 0)]
    assert list(reader.pushFilters(pushed)) == pushed[2:]
    parts = reader.partitions()
    assert [p.folders for p in parts] == [[f"{tmp_path}/b"]] and [r[2] for r in reader.read(parts[0])] == ["x.mat"]
    for on in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        df = files.listing(spark, root=str(tmp_path)).filter("folder LIKE '%' AND name IN ('x.mat', 'z') AND length < 1")
        assert sorted(r.folder[-1] for r in df.collect()) == ["a", "b", "c"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_listing_stream_has_each_file_once(spark, tmp_path):
    """By the same query, stopped and taken up again."""
    spark.dataSource.register(FolderListing)
    root, seen = tmp_path / "in", []
    for k, wave in enumerate((["a/1", "a/2"], ["a/3", "b/1", "b/.no"], [])):
        for name in wave:
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_bytes(b"x" * k)
        time.sleep(0.4)
        source = spark.readStream.format("folder_listing").option("root", str(root)).option("settle", 0.1).load()
        run = source.writeStream.foreachBatch(lambda df, i: seen.extend((r.path, r.length) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        run.awaitTermination()
    assert sorted((p.removeprefix(f"{root}/"), n) for p, n in seen) == [("a/1", 0), ("a/2", 0), ("a/3", 1), ("b/1", 1)]


def test_files_that_cannot_be_written_are_warnings(spark, tmp_path):
    root = str(tmp_path / "out")
    files.drop(spark.createDataFrame([("f", b"1"), ("d/g", None)], "path string, content binary"), root)
    rows = spark.createDataFrame([("f/x", b"2"), ("e/y", b"3"), ("f", b"4")], "path string, content binary").coalesce(1)
    warned = files.drop(rows, root).collect()
    assert [(r.path, bool(r.reason)) for r in warned] == [("f/x", True)]
    read = lambda p: open(f"{root}/{p}", "rb").read()
    assert (read("f"), read("d/g"), read("e/y")) == (b"4", b"", b"3")
    assert not [n for _, _, names in os.walk(root) for n in names if n.startswith(".") and not n.endswith(".crc")]


def test_a_failed_job_leaves_no_warnings(spark, tmp_path):
    root = str(tmp_path / "out")
    files.drop(spark.createDataFrame([("f", b"1")], "path string, content binary"), root)
    fails = F.when(F.col("path") == "z", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))
    rows = spark.createDataFrame([("f/x", b"2"), ("z", b"3")], "path string, content binary").repartition(2).withColumn("content", fails)
    with pytest.raises(Exception, match="lost"):
        files.drop(rows, root)
    assert not [n for _, _, names in os.walk(f"{root}/_warnings") for n in names if n.endswith(".json")]


def test_a_volume_is_decoded_slice_by_slice(spark, tmp_path):
    """The decoder is asked for the next slice only when the one before has left as a batch; failures follow what came."""
    import numpy as np

    asked = []

    def decode(content):
        for k in range(3):
            asked.append(k)
            yield k, np.full((2, 4), float(k))
        if bytes(content) == b"bad":
            raise ValueError("cut off")

    df = spark.createDataFrame([(1, b"ok"), (2, b"bad"), (3, None)], "series_id int, content binary").coalesce(1)
    rows = volume.ingest(df, decode).collect()
    assert [(r.series_id, r.k, r.j, r.vals) for r in rows[:2]] == [(1, 0, 0, [0.0] * 4), (1, 0, 1, [0.0] * 4)]
    assert [r.error for r in rows if r.error] == ["cut off"] and len(rows) == 19
    func = volume.ingest(df, decode)  # the same function on a batch, here: one slice at a time
    import pyarrow as pa

    captured = {}
    fake = type("Blobs", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: captured.setdefault("run", run)})()
    volume.ingest(fake, decode)
    asked.clear()
    batches = captured["run"](iter([pa.RecordBatch.from_pydict({"series_id": pa.array([1], pa.int32()), "content": pa.array([b"ok"])})]))
    for n in range(3):
        assert next(batches).num_rows == 2 and asked == list(range(n + 1))
    assert func.columns[-1] == "error"


def test_stored_volumes_are_pruned(spark, tmp_path):
    """A filter on series opens its folder, one on k its row groups; clicks prune folders when the join runs."""
    lines = spark.range(40_000).selectExpr("int(id / 10000) AS series_id", "int(id % 10000 / 100) AS k", "int(id % 100) AS j", "array(double(id)) AS vals")
    volume.write(lines, str(tmp_path / "v"))
    found = volume.axial_slice(volume.stored(spark, str(tmp_path / "v")), 7).filter("series_id = 2")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(series_id" in plan and "EqualTo(k,7)" in plan
    assert [r.vals for r in found.orderBy("j").limit(2).collect()] == [[20700.0], [20701.0]]
    import pyarrow.parquet as pq

    files_ = list((tmp_path / "v" / "series_id=2").glob("*.parquet"))
    whole = [pq.ParquetFile(f).metadata for f in files_]
    columns = [m.row_group(i).column(0) for m in whole for i in range(m.num_row_groups)]
    groups = [(c.statistics.min, c.statistics.max, c.num_values) for c in columns]
    assert sum(n for *_, n in groups) == 10_000 and sum(n for low, high, n in groups if low <= 7 <= high) <= 5_000  # rows read for a slice
    clicks = spark.createDataFrame([(1, 3)], "click int, series_id int").filter("click = 1")
    joined = volume.stored(spark, str(tmp_path / "v")).join(F.broadcast(clicks), "series_id")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 10_000
