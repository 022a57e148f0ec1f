import json
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lumenframe.operators import catalog, rois
from lumenframe.plans.queries import QUERIES
from lumenframe.streaming import gestures, roi_log, series_log, sinks
from lumenframe.streaming.gestures import Drawing
from tests.twins import DATA

LOG = f"session_id long, seq long, op string, roi_id long, roi_type string, has_color int, tool string, name string, idx int, ex double, ey double, points {rois.POINTS}"
GESTURE = "session_id long, seq long, kind string, tool string, x double, y double, z double, slice_index long, orientation int"


def random_log(seed, n=60):
    r = random.Random(seed)
    ops = ["add"] * 4 + ["remove"] * 3 + ["select"] * 2 + ["rename"] * 2 + ["translate", "update", "insert", "insert", "delete", "delete", "tool", "clear"]
    points = lambda op: [(float(r.randint(0, 9)), float(r.randint(0, 9)), 1.0) for _ in range(r.randint(1, 5))] if op == "add" else None
    return [
        (s, i, op, r.randint(1, 6), r.choice(["rectangle", "polygon"]), r.randint(0, 1), r.choice(["edit", "polygon"]), r.choice(["  ", " a ", "b"]), r.randint(-1, 5), float(r.randint(0, 5)), float(r.randint(0, 5)), points(op))
        for s in range(4) for i in range(n) for op in [r.choice(ops)]
    ]


def play(spark, rows, schema, tmp_path, job, parts=3):
    """The rows as a stream of a few files, in order of seq."""
    rows = sorted(rows, key=lambda x: x[1])
    for i in range(parts):
        spark.createDataFrame(rows[len(rows) * i // parts : len(rows) * (i + 1) // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = job(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_log_stream_equals_batch(spark, tmp_path):
    """The feed of the stream tells what the batch tells, and amounts to the batch's table: names, colours, points, selection."""
    rows = random_log(3)
    log = spark.createDataFrame(rows, LOG)
    feed = play(spark, rows, LOG, tmp_path, roi_log.changes)
    got = lambda df: sorted(map(str, df.collect()))
    want = rois.changes(log)
    assert got(roi_log.listeners(feed).select(*want.columns)) == got(want)
    whole = rois.table(log)
    assert got(roi_log.current(feed).select(*whole.columns)) == got(whole) and whole.count() > 3


def test_vertices_that_come_and_go_are_told(spark):
    row = lambda i, op, idx=None, n=0: (1, i, op, 1, "polygon", 0, None, None, idx, 9.0, 9.0, [(float(k), 0.0, 0.0) for k in range(n)] or None)
    log = spark.createDataFrame([row(1, "add", n=3), row(2, "delete", 0), row(3, "insert", 1), row(4, "delete", 7), row(5, "delete", 0), row(6, "update", 0), row(7, "translate"), row(8, "tool")], LOG)
    told = [(r.seq, r.event) for r in rois.changes(log).orderBy("seq", "no").collect()]
    assert told == [(1, "added"), (1, "changed"), (3, "changed"), (5, "changed"), (8, "selection")]


def test_late_rows_are_marked(spark, tmp_path):
    row = lambda i: (1, i, "add", None, "polygon", 0, None, None, None, None, None, None)
    for rows in ([row(5)], [row(5), row(6)]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = roi_log.changes(source).writeStream.format("memory").queryName("late_rows").trigger(availableNow=True).start()
    run.awaitTermination()
    events = [r.event for r in spark.table("late_rows").collect()]
    assert events.count("late") == 1 and events.count("added") == 2


def test_registered_gesture_stream_equals_batch(spark):
    got = [sorted(map(str, QUERIES[q](spark, DATA).collect())) for q in ("gesture_stream", "gesture_rois")]
    assert got[0] == got[1] and got[0]


def test_gesture_stream_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gestures, "ESCAPES", 2)
    r = random.Random(4)
    kinds = ["tool", "left_press", "left_press", "move", "move", "left_release", "right_press", "escape"]
    rows = [(s, i, r.choice(kinds), r.choice(["rectangle", "ellipse", "polygon", "freehand"]), float(r.randint(0, 3)), float(r.randint(0, 3)), 0.0, i, 2) for s in range(3) for i in range(120)]
    batch = gestures.batch(spark.createDataFrame(rows, GESTURE))
    stream = play(spark, rows, GESTURE, tmp_path, gestures.stream)
    got = lambda df: sorted(map(str, df.collect()))
    assert got(stream.select(*batch.columns)) == got(batch)


@pytest.mark.parametrize(("n", "event"), [(2, "cancelled"), (3, "roi")])
def test_polygon_right_press(n, event):
    d = Drawing("polygon")
    for i in range(n):
        assert d.step("left_press", "", (float(i), 0.0, 0.0)) is None
    assert d.step("right_press", "", (0.0, 0.0, 0.0))[0] == event


def test_tool_change_keeps_a_drawing():
    d = Drawing("freehand")
    d.step("left_press", "", (0.0, 0.0, 0.0))
    d.step("move", "", (1.0, 0.0, 0.0))
    d.step("tool", "polygon", (0.0, 0.0, 0.0))
    assert d.drawing and len(d.points) == 2


def test_release_where_pressed_cancels():
    d = Drawing("rectangle")
    d.step("left_press", "", (1.0, 1.0, 0.0))
    assert d.step("left_release", "", (1.0, 1.0, 0.0))[0] == "cancelled" and d.tool == "none"


def test_partitions_do_not_matter(spark):
    log = spark.createDataFrame(random_log(9), LOG)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, rois.changes(log.orderBy(F.rand(1))).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


@pytest.mark.parametrize("tool", ["rectangle", "ellipse"])
def test_release_without_an_anchor_cancels(tool):
    """A freehand drawing under way, then a change of tool: there is no first corner."""
    d = Drawing("freehand")
    for kind, to, at in [("left_press", "", 0.0), ("move", "", 1.0), ("tool", tool, 1.0), ("move", "", 2.0)]:
        assert d.step(kind, to, (at, 0.0, 0.0)) is None
    assert d.step("left_release", "", (5.0, 5.0, 0.0)) == ("cancelled", tool, [])
    assert (d.tool, d.drawing, d.points) == ("none", False, [])


@pytest.mark.parametrize(
    ("tool", "kind", "event", "n"),
    [("freehand", "left_release", "roi", 2), ("polygon", "right_press", "cancelled", 0), ("polygon", "left_press", None, 3), ("polygon", "left_release", None, 2), ("rectangle", "right_press", None, 2), ("edit", "left_release", None, 2), ("none", "left_press", None, 2), ("rectangle", "left_press", None, 1), ("freehand", "left_press", None, 1)],
)
def test_rules_after_a_change_of_tool(tool, kind, event, n):
    """Two points are drawn by hand; what each event does once another tool is chosen."""
    d = Drawing("freehand")
    d.step("left_press", "", (0.0, 0.0, 0.0))
    d.step("move", "", (1.0, 0.0, 0.0))
    d.step("tool", tool, (1.0, 0.0, 0.0))
    done = d.step(kind, "", (7.0, 8.0, 0.0))
    assert (done and done[0], len(done[2]) if done else len(d.points)) == (event, n)


def step(spark, tmp_path, rows, schema, job, keep, **trigger):
    """A wave of rows, by the query that stands in tmp_path."""
    if rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    sinks.routed(job(source), str(tmp_path / "late"), keep, str(tmp_path / "state"), **trigger).awaitTermination()


@pytest.mark.parametrize("fails", ["before", "after"])
def test_table_survives_a_failed_batch(spark, tmp_path, fails):
    """A batch that fails before or after its commit, and comes again: the table is the batch's, one row a ROI."""
    rows = sorted(random_log(11), key=lambda r: r[1])
    table = sinks.RoiTable(spark, str(tmp_path / "table"), buckets=3)
    calls = []

    def keep(feed, batch):
        calls.append(batch)
        if calls == [0, 1] and fails == "before":
            table._folders([])  # nothing is committed
            raise RuntimeError("lost")
        done = table.merge(feed, batch)
        if calls == [0, 1]:
            raise RuntimeError("lost")
        assert done or calls == [0, 1, 1]

    step(spark, tmp_path, rows[:120], LOG, roi_log.changes, keep)
    with pytest.raises(Exception, match="lost"):
        step(spark, tmp_path, rows[120:180], LOG, roi_log.changes, keep)
    step(spark, tmp_path, rows[180:], LOG, roi_log.changes, keep)
    assert calls[:3] == [0, 1, 1] and len(calls) == 4
    whole = rois.table(spark.createDataFrame(rows, LOG))
    got = roi_log.shaped(table.read()).select(*whole.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    keys = [(r.session_id, r.roi_id) for r in table.read().collect()]
    assert len(keys) == len(set(keys)) > 3
    versions = table.manifest.versions()
    table.vacuum(keep=1)
    assert table.manifest.versions() == versions[-1:] and table.read().count() == len(keys)


def test_a_batch_writes_a_roi_once(spark, tmp_path):
    row = lambda i, op, ex=0.0: (1, i, op, 1, "polygon", 0, None, None, 0, ex, 0.0, [(0.0, 0.0, 0.0)] * 3 if op == "add" else None)
    feed = play(spark, [row(0, "add"), *(row(i, "translate", 1.0) for i in range(1, 500))], LOG, tmp_path, roi_log.changes, parts=2)
    rows = feed.filter("event = 'row'").orderBy("seq").collect()
    assert len(rows) == 2 and rows[-1].xs == [499.0] * 3


def test_late_rows_go_to_their_own_sink(spark, tmp_path):
    row = lambda s, i: (s, i, "add", None, "polygon", 0, None, None, None, None, None, None)
    seen = []
    keep = lambda feed, batch: seen.extend(r.event for r in feed.collect())
    step(spark, tmp_path, [row(1, 5), row(2, 1)], LOG, roi_log.changes, keep)
    step(spark, tmp_path, [row(1, 3), row(1, 5), row(1, 6), row(2, 2)], LOG, roi_log.changes, keep)
    late = spark.read.parquet(str(tmp_path / "late"))
    assert sorted((r.session_id, r.seq) for r in late.collect()) == [(1, 3), (1, 5)]
    assert "late" not in seen and seen.count("added") == 4


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """Session 1 is idle for longer than the limit, session 2 is not: the first begins anew, even with an old seq."""
    row = lambda s, i: (s, i, "add", None, "polygon", 0, None, None, None, None, None, None)
    idle, found = 9_000, []
    job = lambda log: roi_log.changes(log, idle)
    keep = lambda feed, batch: found.extend((r.session_id, r.seq, r.roi_id) for r in feed.filter("event = 'added'").collect())
    step(spark, tmp_path, [row(1, 7), row(2, 7)], LOG, job, keep, once=True)
    first = time.time()
    time.sleep(4)
    step(spark, tmp_path, [row(2, 8)], LOG, job, keep, once=True)
    second = time.time()
    time.sleep(max(0.0, first + idle / 1000 + 0.5 - time.time()))
    step(spark, tmp_path, [row(2, 9)], LOG, job, keep, once=True)  # session 1's timer has run out
    assert time.time() < second + idle / 1000, "too slow to tell"
    head = spark.read.format("statestore").option("stateVarName", "head").load(str(tmp_path / "state"))
    assert [r.key.session_id for r in head.collect()] == [2]
    step(spark, tmp_path, [row(1, 2), row(2, 10)], LOG, job, keep, once=True)
    assert sorted(found) == [(1, 2, 1), (1, 7, 1), (2, 7, 1), (2, 8, 2), (2, 9, 3), (2, 10, 4)]


def test_idle_drawings_are_forgotten(spark, tmp_path):
    """A press, a long pause, a release: nothing is drawn; without a limit it is."""
    row = lambda i, kind, x: (1, i, kind, "rectangle", x, x, 0.0, 0, 2)
    for limit, events in ((300, []), (None, ["roi"])):
        found, at = [], tmp_path / str(limit)
        keep = lambda out, batch, found=found: found.extend(r.event for r in out.collect())
        job = lambda g, limit=limit: gestures.stream(g, limit)
        step(spark, at, [row(1, "tool", 0.0), row(2, "left_press", 1.0)], GESTURE, job, keep, once=True)
        time.sleep(0.5)
        step(spark, at, [row(3, "left_release", 4.0)], GESTURE, job, keep, once=True)
        assert found == events


def test_series_stream_equals_batch(spark, tmp_path):
    """In three waves, with a restart between them, and one late row."""
    r = random.Random(6)
    schema = "session_id long, seq long, op string, folder string"
    rows = sorted(((s, i, r.choice(["add"] * 6 + ["load"]), r.choice([*"abcd", None])) for s in range(5) for i in range(40)), key=lambda x: x[1])
    found = []
    keep = lambda out, batch: found.extend((x.session_id, x.seq, x.epoch, x.folder) for x in out.collect())
    for wave in (rows[:50], rows[50:120], [*rows[120:], (1, 3, "load", "z")]):
        step(spark, tmp_path, wave, schema, series_log.stream, keep)
    want = catalog.deduped(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, found)) == sorted(str((x.session_id, x.seq, x.epoch, x.folder)) for x in want)
    assert [(x.session_id, x.seq) for x in spark.read.parquet(str(tmp_path / "late")).collect()] == [(1, 3)]


class Store:
    """A session's state in memory; each call of it is a round trip from a worker."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, []

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def iterator(self):
        return iter([])

    def updateValue(self, key, value):
        self.map[key] = value


@pytest.mark.parametrize("job", ["gestures", "series"])
def test_a_session_is_read_and_written_once_and_without_data_frames(job):
    store, processor = Store(), gestures.DrawingProcessor() if job == "gestures" else series_log.LoadProcessor()
    processor.init(store)
    press = lambda i, kind, x: Row(session_id=1, seq=i, kind=kind, tool="rectangle", x=x, y=x, z=0.0, slice_index=0, orientation=2)
    add = lambda i, folder: Row(session_id=1, seq=i, op="add", folder=folder)
    rows = [press(3, "left_release", 4.0), press(1, "tool", None), press(2, "left_press", 1.0)] if job == "gestures" else [add(2, "b"), add(1, "a"), add(3, "a")]
    out = list(processor.handleInputRows((1,), iter(rows), None))
    assert [(r.seq, r.event) for r in out] == ([(3, "roi")] if job == "gestures" else [(1, "added"), (2, "added")])
    assert store.calls == ["get", "update"]


def test_edits_reach_a_session_as_text_and_its_rois_are_kept_in_parts():
    """Not a cell for each column, a row for each event, an entry for each ROI."""
    store, processor = Store(), roi_log.LogProcessor()
    processor.init(store)
    edit = lambda i: {"seq": i, "op": "add", "roi_type": "polygon", "has_color": 0, "xs": [1.5, None], "ys": [2.0, "NaN"], "zs": [0.0, 0.0]}
    rows = [Row(session_id=1, edit=json.dumps(edit(i))) for i in range(1_000, 0, -1)]
    told = [r.told for r in processor.handleInputRows((1,), iter(rows), None)]
    assert [len(t) for t in told] == [1_000, 1_000, 1_000]  # added, changed and the ROI itself
    assert [(e[1], e[3], e[4]) for e in told[0][:3]] == [(1, "added", 1), (1, "changed", None), (2, "added", 2)]
    assert told[2][-1][1:7] == (1_000, 9, "row", 1_000, "polygon", "Polygon 1000") and told[2][-1][8] == [1.5, None]
    assert store.calls == ["get", "update"] and sorted(store.map) == [(part,) for part in range(1_000 // roi_log.LIVE + 1)]


def test_log_stream_takes_odd_values_as_the_batch_does(spark, tmp_path):
    """Nulls, numbers that are none, ids beyond 2^53 among nulls, text that JSON escapes: in three micro-batches."""
    r = random.Random(8)
    odd = {"roi_id": [None, 2**53 + 1], "has_color": [None], "tool": [None], "name": [None, ' "q\\ué\n\u2028😀 '], "ex": [None, float("nan"), float("inf"), 0.1 + 0.2], "ey": [None, -0.0, 1e-300], "idx": [None]}
    names = [c.split(" ")[0] for c in LOG.split(", ")][:11]
    rows = [tuple(r.choice(odd[c]) if c in odd and r.random() < 0.2 else v for c, v in zip(names, row)) + row[11:] for row in random_log(12, 90)]
    rows = [(*row[:11], row[11] and [(None, 2.0, 1.0), *row[11]]) for row in rows]
    log, got = spark.createDataFrame(rows, LOG), lambda df: sorted(map(str, df.collect()))
    feed = play(spark, rows, LOG, tmp_path, roi_log.changes)
    want, whole = rois.changes(log), rois.table(log)
    assert got(roi_log.listeners(feed).select(*want.columns)) == got(want)
    assert got(roi_log.current(feed).select(*whole.columns)) == got(whole) and whole.count() > 3
