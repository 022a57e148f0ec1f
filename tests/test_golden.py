import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumenframe.functions.text import fixed
from lumenframe.operators import catalog, rois, volume
from lumenframe.sources import sessions

LOG = "session_id long, seq long, op string, roi_id long, roi_type string, has_color int"


def log(spark, *ops):
    return spark.createDataFrame([(1, i + 1, *op) for i, op in enumerate(ops)], LOG)


ADD = ("add", None, "rectangle", 0)


def one(df):
    (row,) = df.collect()
    return row


def test_square_rectangle(spark):
    r = one(spark.range(1).select(rois.rectangle(*map(F.lit, (0.0, 0.0, 4.0, -2.0, 5.0))).alias("p")))
    assert [tuple(p) for p in r.p] == [(0, 0, 5), (2, 0, 5), (2, -2, 5), (0, -2, 5)]


def test_ellipse(spark):
    r = one(spark.range(1).select(rois.ellipse(*map(F.lit, (0.0, 0.0, 0.0, 4.0, 2.0, 2.0))).alias("p")))
    assert len(r.p) == 64 and tuple(r.p[0]) == (4, 1, 1)


@pytest.mark.parametrize(("x", "hit"), [(10.0, None), (9.999, 0)])
def test_vertex_threshold_is_strict(spark, x, hit):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 500.0, 0.0)], "roi_id long, vertex_idx int, x double, y double")
    c = spark.createDataFrame([(7, 1, x, 0.0)], "click_id long, roi_id long, px double, py double")
    assert one(rois.nearest_vertex(c, v)).vertex_idx == hit


def test_first_vertex_wins_ties(spark):
    v = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, -1.0, 0.0)], "roi_id long, vertex_idx int, x double, y double")
    c = spark.createDataFrame([(7, 1, 0.0, 0.0)], "click_id long, roi_id long, px double, py double")
    assert one(rois.nearest_vertex(c, v)).vertex_idx == 0


def test_half_even_index_and_order(spark):
    g = spark.createDataFrame([(1, 10, 10, 10, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0)], "series_id int, nx int, ny int, nz int, sx double, sy double, sz double, ox double, oy double, oz double")
    lines = spark.createDataFrame([(1, 4, j, [float(100 * j + i) for i in range(10)]) for j in range(10)], "series_id int, k int, j int, vals array<double>")
    p = spark.createDataFrame([(1, 1, 2, 4, 2.5, 3.5, 0.0), (2, 1, 2, 4, 9.6, 0.0, 0.0), (3, 1, 2, 4, -0.5, 0.0, 0.0)], "click_id int, series_id int, orientation int, slice_index int, x double, y double, z double")
    found = {r.click_id: (r.row, r.col, r.value) for r in volume.sample(p, g, lines).collect()}
    assert found == {1: (4, 2, 402.0), 3: (0, 0, 0.0)}


def points(n):
    return [Row(x=float(i), y=0.0, z=0.0) for i in range(n)]


def folded(spark, n, *edits):
    r = spark.createDataFrame([(1, points(n))], f"roi_id long, points {rois.POINTS}")
    e = spark.createDataFrame([(1, i, *x) for i, x in enumerate(edits)], "roi_id long, seq long, op string, idx int, ex double, ey double")
    return [(p.x, p.y) for p in one(rois.fold(r, e)).points]


def test_fold(spark):
    assert folded(spark, 3, ("delete", 0, None, None)) == [(0, 0), (1, 0), (2, 0)]
    assert folded(spark, 3, ("insert", 1, 9.0, 9.0)) == [(0, 0), (1, 0), (9, 9), (2, 0)]
    assert folded(spark, 3, ("insert", 99, 9.0, 9.0)) == [(0, 0), (1, 0), (2, 0), (9, 9)]
    assert folded(spark, 4, ("delete", 4, None, None), ("delete", -1, None, None), ("delete", 1, None, None)) == [(0, 0), (2, 0), (3, 0)]
    assert folded(spark, 2, ("translate", None, 1.0, 2.0), ("update", 0, 5.0, 5.0), ("update", 2, 7.0, 7.0)) == [(5, 5), (2, 2)]


def test_id_goes_on_after_clear(spark):
    df = log(spark, ADD, ADD, ("clear", None, None, 0), ADD)
    assert [r.roi_id for r in rois.adds(df).orderBy("seq").collect()] == [1, 2, 3]
    assert [r.roi_id for r in rois.live(df).collect()] == [3]


def test_name_repeats_after_delete(spark):
    df = log(spark, ADD, ADD, ("remove", 1, None, 0), ADD)
    assert [r.name for r in rois.named(df).orderBy("seq").collect()] == ["Rectangle 1", "Rectangle 2", "Rectangle 2"]


def test_color_wraps(spark):
    rows = rois.adds(log(spark, *[ADD] * 9)).orderBy("seq").select(rois.palette(F.col("color_no")).alias("c")).collect()
    assert rows[8].c == rows[0].c == list(rois.PALETTE[0]) and rows[1].c == list(rois.PALETTE[1])


def test_remove_of_a_later_id_is_nothing(spark):
    assert [r.roi_id for r in rois.live(log(spark, ("remove", 1, None, 0), ADD)).collect()] == [1]


def test_selection(spark):
    assert one(rois.selected(log(spark, ADD, ("select", 1, None, 0), ("remove", 1, None, 0)))).selected is None
    assert one(rois.selected(log(spark, ("select", 9, None, 0), ADD))).selected == 9
    assert one(rois.selected(log(spark, ADD, ("select", 1, None, 0), ("clear", None, None, 0)))).selected is None


def test_clamped_wheel(spark):
    r = one(spark.range(1).select(volume.wheel(F.array(F.lit(1), F.lit(1), F.lit(-1)), F.lit(2), F.lit(0), F.lit(2)).alias("s")))
    assert r.s == 1


def test_session_null_and_missing(spark):
    raw = ['{"use_dicom_spacing":null}', "{}", "{bad", "[1]", None, '{"last_dicom_folder":"/a","last_dicom_folders":[]}', '{"a":1,"a":2}']
    df = sessions.read(spark.createDataFrame(list(enumerate(raw)), "session_id long, raw string"))
    found = {r.session_id: r for r in df.collect()}
    assert found[0].use_series is None and found[1].use_series is True
    assert [found[i].status for i in range(7)] == ["ok", "ok", "corrupt", "corrupt", "corrupt", "ok", "corrupt"]
    assert found[2].custom_spacing == [1.0, 1.0, 1.0] and found[5].folders == ["/a"]


def test_roi_with_a_missing_key_breaks_its_list(spark):
    raw = '{"rois":[{"name":"a","roi_type":"r","slice_index":1,"orientation":2,"points":[[1,2,3]]}]}'
    rows = sessions.read(spark.createDataFrame([(1, raw)], "session_id long, raw string"))
    assert sessions.deserialise(rows).count() == 0 and sessions.broken(rows).count() == 1


def test_labels(spark):
    df = spark.createDataFrame([(" 3 ", "", "/a/b"), (None, "\t ", "/a/b/"), ("1", "x ", "/c")], "n string, d string, f string")
    assert [r.l for r in df.select(catalog.label(F.col("n"), F.col("d"), F.col("f")).alias("l")).collect()] == ["3", "b", "1 – x"]


def test_window_level_needs_both(spark):
    df = spark.createDataFrame([(80.0, None), (80.0, 20.0)], "w double, l double")
    ww, wl = catalog.window_level(F.col("w"), F.col("l"))
    assert [tuple(r) for r in df.select(ww, wl).collect()] == [(400.0, 40.0), (80.0, 20.0)]


def test_exact_decimals(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (None,)], "x double")
    assert [r.t for r in df.select(fixed(F.col("x"), 2).alias("t")).collect()] == ["0.12", "2.67", None]


def test_segment_distance(spark):
    d = lambda *a: one(spark.range(1).select(rois.segment_distance(*map(F.lit, map(float, a))).alias("d"))).d
    assert d(0, 3, -1, 0, 1, 0) == 3 and d(4, 4, 1, 0, 1, 0) == 5 and math.isclose(d(3, 4, 0, 0, 0, 0), 5)


def test_grey_of_a_zero_window(spark):
    r = one(spark.range(1).select(volume.grey(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(0.0), F.lit(2.0)).alias("g")))
    assert r.g == [0, 255, 255]


@pytest.mark.parametrize(("nx", "ny", "brick"), [(1, 1, 8), (8, 8, 8), (19, 7, 4), (5, 23, 8), (40, 33, 32)])
def test_sagittal_bricks(spark, nx, ny, brick):
    """Turned by bricks that the volume does not divide into; whole pieces are shuffled."""
    rows = [(0, k, j, [float(i + 100 * j + 10_000 * k) for i in range(nx)]) for k in range(3) for j in range(ny)]
    df = volume.sagittal(spark.createDataFrame(rows, "series_id int, k int, j int, vals array<double>").repartition(3), brick)
    got = {(r.k, r.j): r.vals for r in df.collect()}
    assert got == {(i, k): [float(i + 100 * j + 10_000 * k) for j in range(ny)] for i in range(nx) for k in range(3)}
    assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_one_long_session_is_counted_by_segments(spark, monkeypatch):
    """A session of 20,000 rows and small ones: ids, colours, names and lifetimes as by plain windows, in more than one task."""
    import random

    r = random.Random(3)
    ops = ["add"] * 3 + ["remove"] * 2 + ["rename", "select"]
    row = lambda s, i: (s, i, "clear" if r.random() < 0.001 else r.choice(ops), r.randint(1, 40), r.choice(["rectangle", "polygon"]), r.randint(0, 1))
    rows = [row(1, i) for i in range(5, 20_005)] + [row(s, i) for s in range(2, 30) for i in range(50)]
    df = spark.createDataFrame(rows, LOG).repartition(4)
    got = lambda f: sorted(map(str, f(df).collect()))
    for f in (rois.lifetimes, rois.named):
        monkeypatch.setattr(rois, "SEGMENT", 10**9)
        plain = got(f)
        monkeypatch.setattr(rois, "SEGMENT", 1_000)
        assert got(f) == plain and len(plain) > 8_000
    counted = rois._running(df, ["session_id"], {"n": F.lit(1)}, {}).filter("session_id = 1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together
    assert counted.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counted.agg(F.max("n")).first()[0] == 20_000


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_ranks(spark, n):
    from lumenframe.functions.ranks import ranked

    rows, total = ranked(spark.range(n).select((F.col("id") * 7 % 1009).alias("key")).repartition(3), "key")
    got = sorted((r.key, r["rank"]) for r in rows.collect())
    assert total == n and got == [(k, i) for i, k in enumerate(sorted(i * 7 % 1009 for i in range(n)))]


@pytest.mark.parametrize("block", [10, 60, 50_000])
def test_nearest_region_in_a_hot_tile(spark, block):
    """Most clicks and edges lie in one tile, some far out; blocks, cells and tiles change nothing, ties go to the smallest id."""
    import random

    r = random.Random(block)
    place = lambda: (r.uniform(0, 30), r.uniform(0, 30)) if r.random() < 0.8 else (r.uniform(-60, 90), r.uniform(-60, 90))
    edges = []
    for i in range(150):
        (x, y), (dx, dy) = place(), (r.uniform(-9, 9), r.choice([0.0, r.uniform(-9, 9)]))
        edges.append((i, 1, 2, 0, x, y, x + dx, y + dy))
    edges += [(900 + i, *e[1:]) for i, e in enumerate(edges[:40])] + [(500, 1, 1, 0, 5.0, 5.0, 6.0, 6.0)]
    clicks = [(i, r.choice([1, 1, 2]), r.choice([2, 2, 1]), *place()) for i in range(200)] + [(1000 + i, 1, 2, 7.0, 7.0) for i in range(100)]
    got = rois.nearest_roi(
        spark.createDataFrame(clicks, "click_id long, slice_index int, orientation int, px double, py double"),
        spark.createDataFrame(edges, "roi_id long, slice_index int, orientation int, edge_idx int, ax double, ay double, bx double, by double"), block=block,
    )

    def far(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(px - ax - t * dx, py - ay - t * dy)

    want = {}
    for i, s, o, x, y in clicks:
        near = sorted((round(d, 9), e[0]) for e in edges if (e[1], e[2]) == (s, o) and (d := far(x, y, *e[4:])) < 8)
        want[i] = near[0][1] if near else None
    assert {g.click_id: g.nearest for g in got.collect()} == want and any(want.values()) and None in want.values()
