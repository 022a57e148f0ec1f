"""Regions of interest: ids, colours, names and the live set from an edit log; vertex edits; picking by distance.

A log row is (session_id, seq, op, roi_id, ...); seq orders a session. Ids count a session's adds, never start again, and
stay unused after a removal. Everything here is windows and equi-joins per session; ids, colours and names of long sessions
are counted by segments, so that one session spreads over tasks too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.shared import shared_dir

#: The palette.
PALETTE = [(1.0, 0.2, 0.2), (0.2, 1.0, 0.2), (0.3, 0.6, 1.0), (1.0, 1.0, 0.2), (1.0, 0.5, 0.0), (0.8, 0.2, 1.0), (0.0, 1.0, 1.0), (1.0, 0.4, 0.7)]
VERTEX, EDGE, FAR = 10.0, 8.0, 15.0  # distances, all strict
SEGMENT = 16_384  # seqs of a long log that are counted together
CELLS, HOT = 16, 4  # cells along a side of a hot tile; blocks of points beyond which a tile is hot
BLOCK, TILES = 50_000, 200_000  # edges, or points, of a tile that meet in one task; tiles or cells that are broadcast
POINTS = "array<struct<x:double,y:double,z:double>>"


def _seq():
    return Window.partitionBy("session_id").orderBy("seq")


def _running(rows: DataFrame, keys: list[str], sums: dict[str, Column], following: dict[str, Column]) -> DataFrame:
    """rows with running sums by seq, the row itself included, for each value of keys; and, in `following`, the least value of
    the rows after it. Where seqs span more than SEGMENT, in two levels: sums within segments of so many seqs, which are
    unique, and sums over the segments before, so that no task holds a long log's rows."""
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    inner = keys
    if low is not None and high - low >= SEGMENT:
        inner = [*keys, "_segment"]
        rows = rows.withColumn("_segment", F.floor((F.col("seq") - low) / SEGMENT))
        own = rows.groupBy(*inner).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()), *(F.min(c).alias(f"_{n}") for n, c in following.items()))
        w = Window.partitionBy(*keys).orderBy("_segment")
        before, after = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.desc("_segment")).rowsBetween(Window.unboundedPreceding, -1)
        own = own.select(*inner, *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums), *(F.min(f"_{n}").over(after).alias(f"_{n}") for n in following))
    w = Window.partitionBy(*inner).orderBy("seq")
    for n, c in sums.items():
        rows = rows.withColumn(n, F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*inner).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)  # a frame up to the end is counted anew for each row
    for n, c in following.items():
        rows = rows.withColumn(n, F.min(c).over(back))
    if inner == keys:
        return rows
    own = own.withColumnsRenamed({k: f"_of_{k}" for k in inner})
    same = F.lit(True)
    for k in inner:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    both = rows.join(own, same)
    for n in sums:
        both = both.withColumn(n, F.col(n) + F.col(f"_{n}"))
    for n in following:
        both = both.withColumn(n, F.coalesce(n, f"_{n}"))
    return both.drop("_segment", *(f"_of_{k}" for k in inner), *(f"_{n}" for n in [*sums, *following]))


def adds(log: DataFrame) -> DataFrame:
    """The add rows with their id, the clears before them (epoch), and the place of their colour (null: own colour)."""
    is_add, clear = F.col("op") == "add", F.col("op") == "clear"
    sums = {"epoch": clear.cast("int"), "id": is_add.cast("int"), "nth": (is_add & (F.col("has_color") == 0)).cast("int")}
    rows = _running(log.drop("epoch", "id", "nth"), ["session_id"], sums, {"_clear": F.when(clear, F.col("seq"))})
    rows = rows.filter(is_add).withColumn("color_no", F.when(F.col("has_color") == 0, F.col("nth")))
    return rows.drop("roi_id", "nth").withColumnRenamed("id", "roi_id").withColumn("roi_id", F.col("roi_id").cast("long"))


def palette(number: Column) -> Column:
    colors = F.array(*(F.array(*map(F.lit, c)) for c in PALETTE))
    return F.get(colors, ((number - 1) % len(PALETTE)).cast("int"))


def lifetimes(log: DataFrame) -> DataFrame:
    """adds with removed (seq of the removal that took effect) and end (of that or the clear)."""
    a = adds(log)
    r = log.filter("op = 'remove'").select("session_id", "roi_id", F.col("seq").alias("_r"))
    hit = a.join(r, ["session_id", "roi_id"]).filter((F.col("_r") > F.col("seq")) & (F.col("_clear").isNull() | (F.col("_r") < F.col("_clear"))))
    first = hit.groupBy("session_id", "roi_id").agg(F.min("_r").alias("removed"))
    out = a.join(first, ["session_id", "roi_id"], "left").withColumn("end", F.coalesce("removed", "_clear"))
    return out.drop("_clear")


def live(log: DataFrame) -> DataFrame:
    return lifetimes(log).filter("end IS NULL")


def named(log: DataFrame) -> DataFrame:
    """The adds with the name given then: the type and one more than the live ROIs of that type."""
    life = lifetimes(log)
    steps = life.select("session_id", "epoch", "roi_type", "seq", F.lit(1).alias("d"), "roi_id").union(
        life.filter("removed IS NOT NULL").select("session_id", "epoch", "roi_type", "removed", F.lit(-1), F.lit(None).cast("long"))
    )
    steps = _running(steps, ["session_id", "epoch", "roi_type"], {"n": F.col("d")}, {}).filter("d = 1")
    return steps.select("session_id", "roi_id", "seq", "roi_type", F.concat_ws(" ", F.initcap(F.lower("roi_type")), F.col("n").cast("string")).alias("name"))


def renamed(log: DataFrame, name: str) -> DataFrame:
    """The live ROIs with the last name they were given; blank names and names for ROIs not there count nothing."""
    given = log.filter("op = 'rename'").select("session_id", "roi_id", F.col("seq").alias("_s"), F.trim(name).alias("_name")).filter("_name <> ''")
    base = live(log).drop("name").join(named(log).select("session_id", "roi_id", "name"), ["session_id", "roi_id"])
    last = base.select("session_id", "roi_id", "seq").join(given, ["session_id", "roi_id"]).filter("_s > seq").groupBy("session_id", "roi_id").agg(F.max_by("_name", "_s").alias("_name"))
    return base.join(last, ["session_id", "roi_id"], "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")


def _deselects(log: DataFrame) -> Column:
    """Rows that select nothing: a clear, or a change to a tool that does not edit (logs without tools have none)."""
    tool = F.col("tool") if "tool" in log.columns else F.lit(None).cast("string")
    return (F.col("op") == "clear") | ((F.col("op") == "tool") & ~F.coalesce(tool == "edit", F.lit(False)))


def selected(log: DataFrame) -> DataFrame:
    """session_id, selected: null after a clear or another tool, or after a removal of the selected id since."""
    last = log.filter((F.col("op") == "select") | _deselects(log)).groupBy("session_id").agg(F.max(F.struct("seq", F.when(F.col("op") == "select", F.col("roi_id")).alias("id"))).alias("s"))
    gone = log.filter("op = 'remove'").select("session_id", F.col("roi_id").alias("_id"), F.col("seq").alias("_r"))
    hit = last.join(gone, (last["session_id"] == gone["session_id"]) & (F.col("s.id") == F.col("_id")) & (F.col("_r") > F.col("s.seq")), "left_semi").select("session_id", F.lit(True).alias("_gone"))
    every = log.select("session_id").distinct().join(last, "session_id", "left").join(hit, "session_id", "left")
    return every.select("session_id", F.when(F.col("_gone").isNull(), F.col("s.id")).alias("selected"))


def changes(log: DataFrame) -> DataFrame:
    """session_id, seq, no, event, roi_id: what listeners are told, in order (no counts within a row)."""
    off = _deselects(log)
    sel = F.last(F.when((F.col("op") == "select") | off, F.struct("seq", F.when(F.col("op") == "select", F.col("roi_id")).alias("id"))), ignorenulls=True).over(_seq().rowsBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy("session_id", "roi_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("_sel", sel).withColumn("_gone", F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(before)).withColumn("_off", off)
    drop = F.coalesce((F.col("_sel.id") == F.col("roi_id")) & (F.col("_gone").isNull() | (F.col("_gone") < F.col("_sel.seq"))), F.lit(False))
    life = lifetimes(log).select("session_id", F.col("roi_id"), F.col("seq").alias("_from"), "end", "removed")
    rows = rows.join(life, ["session_id", "roi_id"], "left").withColumn("_new", F.sum((F.col("op") == "add").cast("long")).over(_seq()))
    if "idx" in log.columns:
        told = edited(log).select("session_id", F.explode("told").alias("seq"), F.lit(True).alias("_told"))
        rows = rows.join(told, ["session_id", "seq"], "left")
    else:
        rows = rows.withColumn("_told", F.lit(False))
    there = F.coalesce((F.col("seq") > F.col("_from")) & (F.col("end").isNull() | (F.col("seq") < F.col("end"))), F.lit(False))
    ev = lambda name, roi=None: F.struct(F.lit(name).alias("event"), (F.lit(None).cast("long") if roi is None else roi).alias("roi_id"))
    none = F.array().cast("array<struct<event:string,roi_id:bigint>>")
    effective = F.coalesce(F.col("removed") == F.col("seq"), F.lit(False))
    out = (
        F.when(F.col("op") == "add", F.array(ev("added", F.col("_new")), ev("changed")))
        .when(F.col("op") == "clear", F.array(ev("selection"), ev("changed")))
        .when(F.col("_off"), F.array(ev("selection")))
        .when(F.col("op") == "select", F.array(ev("selection", F.col("roi_id").cast("long"))))
        .when(F.col("op") == "rename", F.when(there & (F.trim("name") != "" if "name" in log.columns else F.lit(True)), F.array(ev("changed"))).otherwise(none))
        .when(F.col("op") == "remove", F.concat(F.when(drop, F.array(ev("selection"))).otherwise(none), F.when(effective, F.array(ev("removed", F.col("roi_id").cast("long")), ev("changed"))).otherwise(none)))
        .when(F.col("_told"), F.array(ev("changed")))  # a vertex inserted or deleted; other edits of points tell nobody
        .otherwise(none)
    )
    return rows.select("session_id", "seq", F.posexplode(out).alias("no", "e")).select("session_id", "seq", "no", "e.event", "e.roi_id")


EDIT = "struct<seq:bigint,op:string,idx:int,ex:double,ey:double>"
FOLD = f"struct<points:{POINTS},told:array<bigint>>"


def _folded(points: Column, edits: Column) -> Column:
    """points after the edits in order, and the seqs of those that put in or took out a vertex: update and delete need an
    index in range, delete more than three points; insert goes after the edge, past the end to the end; translate moves
    all."""
    point = lambda e: F.struct(e["ex"].alias("x"), e["ey"].alias("y"), F.lit(0.0).alias("z"))

    def step(acc: Column, e: Column) -> Column:
        p = acc["points"]
        ok = (e["idx"] >= 0) & (e["idx"] < F.size(p))
        moved = F.transform(p, lambda q: F.struct((q["x"] + e["ex"]).alias("x"), (q["y"] + e["ey"]).alias("y"), q["z"].alias("z")))
        set_ = F.transform(p, lambda q, i: F.when(i == e["idx"], point(e)).otherwise(q))
        less = F.filter(p, lambda q, i: i != e["idx"])
        put = F.array_insert(p, F.least(e["idx"] + 2, F.size(p) + 1), point(e))
        gone = (e["op"] == "delete") & ok & (F.size(p) > 3)
        out = F.when(e["op"] == "translate", moved).when((e["op"] == "update") & ok, set_).when(e["op"] == "insert", put).when(gone, less).otherwise(p)
        told = F.when((e["op"] == "insert") | gone, F.concat(acc["told"], F.array(e["seq"].cast("long")))).otherwise(acc["told"])
        return F.struct(out.cast(POINTS).alias("points"), told.alias("told")).cast(FOLD)

    start = F.struct(points.cast(POINTS).alias("points"), F.array().cast("array<bigint>").alias("told")).cast(FOLD)
    return F.aggregate(F.coalesce(edits.cast(f"array<{EDIT}>"), F.array().cast(f"array<{EDIT}>")), start, step)


def edited(log: DataFrame) -> DataFrame:
    """lifetimes with points, after all edits of a ROI's life, and told: the seqs at which vertices came or went."""
    life = lifetimes(log)
    edits = log.filter(F.col("op").isin("update", "translate", "insert", "delete")).select("session_id", "roi_id", F.struct("seq", "op", "idx", "ex", "ey").alias("e"))
    span = life.select("session_id", "roi_id", F.col("seq").alias("_from"), "end")
    mine = edits.join(span, ["session_id", "roi_id"]).filter((F.col("e.seq") > F.col("_from")) & (F.col("end").isNull() | (F.col("e.seq") < F.col("end"))))
    mine = mine.groupBy("session_id", "roi_id").agg(F.sort_array(F.collect_list("e")).alias("_e"))
    out = life.join(mine, ["session_id", "roi_id"], "left").withColumn("_f", _folded(F.col("points"), F.col("_e")))
    return out.withColumn("points", F.col("_f.points")).withColumn("told", F.col("_f.told")).drop("_e", "_f")


def table(log: DataFrame) -> DataFrame:
    """The ROIs that are there after a log with names, tools and points: session_id, roi_id, roi_type, name, color (null:
    its own), points, selected."""
    shape = edited(log).filter("end IS NULL").select("session_id", "roi_id", "roi_type", "color_no", "points")
    name = renamed(log, "name").select("session_id", "roi_id", "name")
    out = shape.join(name, ["session_id", "roi_id"]).join(selected(log), "session_id", "left")
    return out.select("session_id", "roi_id", "roi_type", "name", palette(F.col("color_no")).alias("color"), "points", F.coalesce(F.col("selected") == F.col("roi_id"), F.lit(False)).alias("selected"))


def fold(rois: DataFrame, edits: DataFrame) -> DataFrame:
    """rois(roi_id, points) after edits(roi_id, seq, op, idx, ex, ey) in order."""
    log = edits.groupBy("roi_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "idx", "ex", "ey"))).alias("_log"))
    return rois.join(log, "roi_id", "left").withColumn("points", _folded(F.col("points"), F.col("_log"))["points"]).drop("_log")


def nested(vertices: DataFrame) -> DataFrame:
    """Vertex rows -> one row for each ROI with its points in order."""
    rows = vertices.groupBy("roi_id", "slice_index", "orientation").agg(F.sort_array(F.collect_list(F.struct("vertex_idx", "x", "y", "z"))).alias("_p"))
    return rows.withColumn("points", F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))).drop("_p")


def vertex_rows(rois: DataFrame) -> DataFrame:
    return rois.select("roi_id", "slice_index", "orientation", F.posexplode("points").alias("vertex_idx", "p")).select("roi_id", "slice_index", "orientation", "vertex_idx", "p.x", "p.y", "p.z")


def edges(rois: DataFrame) -> DataFrame:
    """roi_id, slice_index, orientation, edge_idx, ax, ay, bx, by: closed outlines; none below two points (a document may have such a
    region; it is then picked by its vertex only)."""
    n = F.size("points")
    turned = F.concat(F.slice("points", F.lit(2), n - 1), F.slice("points", F.lit(1), F.lit(1)))
    e = rois.filter(n >= 2).select("roi_id", "slice_index", "orientation", F.posexplode(F.arrays_zip(F.col("points").alias("a"), turned.alias("b"))).alias("edge_idx", "e"))
    return e.select("roi_id", "slice_index", "orientation", "edge_idx", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(l2, F.lit(0.0))))
    near = l2 < 1e-12
    qx, qy = F.when(near, px - ax).otherwise(px - (ax + t * dx)), F.when(near, py - ay).otherwise(py - (ay + t * dy))
    return F.sqrt(qx * qx + qy * qy)


def nearest_vertex(clicks: DataFrame, vertices: DataFrame, within: float = VERTEX) -> DataFrame:
    """clicks(click_id, roi_id, px, py) with the nearest vertex of that ROI, first on ties, null if none is within."""
    j = clicks.join(vertices.select("roi_id", "vertex_idx", "x", "y"), "roi_id")
    j = j.withColumn("d", F.sqrt((F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y")))).filter(F.col("d") < within)
    best = j.groupBy("click_id").agg(F.min(F.struct("d", "vertex_idx")).alias("m"))
    return clicks.join(best, "click_id", "left").select(*clicks.columns, F.col("m.vertex_idx").alias("vertex_idx"))


def nearest_edge(clicks: DataFrame, outline: DataFrame, within: float = EDGE) -> DataFrame:
    j = clicks.join(outline.select("roi_id", "edge_idx", "ax", "ay", "bx", "by"), "roi_id")
    j = j.withColumn("d", segment_distance(*map(F.col, ("px", "py", "ax", "ay", "bx", "by")))).filter(F.col("d") < within)
    best = j.groupBy("click_id").agg(F.min(F.struct("d", "edge_idx")).alias("m"))
    return clicks.join(best, "click_id", "left").select(*clicks.columns, F.col("m.edge_idx").alias("edge_idx"))


def _segments(e: np.ndarray) -> np.ndarray:
    """Segments (rows ax, ay, bx, by) as rows ax, ay, dx, dy and squared length; ones without length go nowhere."""
    ax, ay, dx, dy = e[0], e[1], e[2] - e[0], e[3] - e[1]
    l2 = dx * dx + dy * dy
    none = l2 < 1e-12
    return np.stack([ax, ay, np.where(none, 0.0, dx), np.where(none, 0.0, dy), np.where(none, 1.0, l2)])


def _distances(x, y, s: np.ndarray) -> np.ndarray:
    """Of points x, y to segments, as segment_distance has them."""
    ax, ay, dx, dy, l2 = s
    t = np.maximum(0.0, np.minimum(1.0, ((x - ax) * dx + (y - ay) * dy) / l2))
    qx, qy = x - (ax + t * dx), y - (ay + t * dy)
    return np.sqrt(qx * qx + qy * qy)


LEAF = 8  # points that are compared with every edge left


def _nearest(x: np.ndarray, y: np.ndarray, e: np.ndarray, roi: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point the least distance (inf: none within) and the smallest roi at it. The square around the points is
    quartered: an edge farther from a quarter's middle than the nearest one and the diagonal is not the nearest of any of
    its points."""
    best, own = np.full(len(x), np.inf), np.full(len(x), -1, dtype=np.int64)
    todo = [(np.arange(len(x)), _segments(e), roi)]
    while todo:
        points, s, of = todo.pop()
        cx, cy = (x[points].min() + x[points].max()) / 2, (y[points].min() + y[points].max()) / 2
        radius = np.hypot(x[points] - cx, y[points] - cy).max()
        d = _distances(cx, cy, s)
        left = np.flatnonzero(d <= min(d.min() + 2 * radius, within + radius) + 1e-6)
        if not len(left):
            continue
        s, of = s[:, left], of[left]
        if len(points) <= LEAF or radius == 0:
            for some in np.array_split(points, -(-len(points) // LEAF)):
                d = _distances(x[some, None], y[some, None], s)
                least = d.min(axis=1)
                first = np.where(d == least[:, None], of, np.iinfo(np.int64).max).min(axis=1)
                near = least < within
                best[some[near]], own[some[near]] = least[near], first[near]
            continue
        right, up = x[points] > cx, y[points] > cy
        for part in (right & up, right & ~up, ~right & up, ~right & ~up):
            if part.any():
                todo.append((points[part], s, of))
    return best, own


def _counted(rows: DataFrame) -> DataFrame:
    """rows, computed once; broadcast if few enough are counted."""
    rows = rows.checkpoint()
    return F.broadcast(rows) if rows.count() <= TILES else rows


def _in_cells(c: DataFrame, e: DataFrame, hot: DataFrame, key: list[str], side: Column, within: float) -> tuple[DataFrame, DataFrame]:
    """Points and edges of tiles with a cell, sx and sy; 0 in tiles that are not hot. In a hot one, a cell's points lie in a
    circle around the middle of their box; an edge farther from there than the nearest edge and the diameter is not the nearest
    of any of them. The nearest edge's distance is a least value for each cell, so no task needs a cell's edges together. Boxes
    and least values are broadcast if they are few: then only the edges that are left are shuffled."""
    cell = side / CELLS
    none = [F.lit(0).cast("long").alias(x) for x in ("sx", "sy")]
    at = lambda v, t: F.least(F.greatest(F.floor(v / cell), F.col(t) * CELLS), F.col(t) * CELLS + CELLS - 1)  # noqa: E731  in the tile
    hot = _counted(hot)
    few_c, few_e = c.join(hot, key, "left_anti").select("*", *none), e.join(hot, key, "left_anti").select("*", *none)
    c, e = c.join(hot, key, "left_semi"), e.join(hot, key, "left_semi")
    c = c.select("*", at(F.col("px"), "tx").alias("sx"), at(F.col("py"), "ty").alias("sy"))
    box = c.groupBy(*key, "sx", "sy").agg(*(f(p).alias(f"{f.__name__}_{p}") for f in (F.min, F.max) for p in ("px", "py")))
    mx, my = (F.col("min_px") + F.col("max_px")) / 2, (F.col("min_py") + F.col("max_py")) / 2
    radius = F.sqrt(F.pow(F.col("max_px") - mx, 2) + F.pow(F.col("max_py") - my, 2))
    box = _counted(box.select(*key, "sx", "sy", mx.alias("mx"), my.alias("my"), radius.alias("radius")))
    span = lambda a, b, t: F.explode(F.sequence(at(F.least(a, b) - within, t), at(F.greatest(a, b) + within, t)))
    e = e.withColumn("sx", span("ax", "bx", "tx")).withColumn("sy", span("ay", "by", "ty")).join(box, [*key, "sx", "sy"])
    e = e.withColumn("d", segment_distance(*map(F.col, ("mx", "my", "ax", "ay", "bx", "by")))).filter(F.col("d") <= within + F.col("radius") + 1e-6)
    least = _counted(e.groupBy(*key, "sx", "sy").agg(F.min("d").alias("least")).withColumnsRenamed({k: f"_{k}" for k in [*key, "sx", "sy"]}))
    same = F.lit(True)
    for k in [*key, "sx", "sy"]:
        same = same & (F.col(k) == F.col(f"_{k}"))
    e = e.join(least, same).filter(F.col("d") <= F.col("least") + 2 * F.col("radius") + 1e-6)
    return few_c.unionByName(c), few_e.unionByName(e.select(few_e.columns))


def nearest_roi(clicks: DataFrame, outline: DataFrame, within: float = EDGE, block: int = BLOCK) -> DataFrame:
    """clicks(click_id, slice_index, orientation, px, py) with the ROI on the same slice and orientation whose edge is
    nearest, the smallest id on ties, null if none is within. Clicks at one place are one point. An edge goes to the square
    tiles that it comes near, of a side of its own length at least (in levels, each twice the last), so to a few at most; a point
    goes to its tile of each level. A tile's points and edges are dealt into counted blocks of about `block`, and every two of
    these meet in a task of their own, so a hot slice or tile is spread; the best of the blocks wins. Edges are shuffled
    once for each block of points; a tile with more than HOT such is cut into cells first, and an edge goes only to those of
    its cells that it may be nearest in."""
    w, place = float(within), ["slice_index", "orientation", "px", "py"]
    side = F.pow(F.lit(2.0), F.col("level")) * (16.0 * w)
    tile = lambda c: F.floor(c / side).cast("long")
    finite = lambda c: F.abs(c) < float("inf")  # noqa: E731  the others are near nothing
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    e = outline.select("roi_id", "slice_index", "orientation", "edge_idx", *(F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")))
    e = e.filter(finite("ax") & finite("ay") & finite("bx") & finite("by"))
    length = F.greatest(high - low, F.abs(F.col("ay") - F.col("by")))
    e = e.withColumn("level", F.when(length > 16.0 * w, F.ceil(F.log2(length / (16.0 * w)))).otherwise(0).cast("int"))
    e = e.withColumn("tx", F.explode(F.sequence(tile(low - w), tile(high + w))))
    # the part of the edge over this column of tiles, wider by the distance on both sides
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    at = lambda x: F.col("ay") + slope * (F.greatest(low, F.least(high, x)) - F.col("ax"))
    y0, y1 = at(F.col("tx") * side - w), at((F.col("tx") + 1) * side + w)
    y0, y1 = F.coalesce(F.least(y0, y1), F.least("ay", "by")), F.coalesce(F.greatest(y0, y1), F.greatest("ay", "by"))
    y0, y1 = F.when(slope.isNull(), F.least("ay", "by")).otherwise(y0), F.when(slope.isNull(), F.greatest("ay", "by")).otherwise(y1)
    e = e.withColumn("ty", F.explode(F.sequence(tile(y0 - w - 1e-6), tile(y1 + w + 1e-6))))
    key = ["slice_index", "orientation", "level", "tx", "ty"]
    blocks = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    shared_dir(clicks.sparkSession)
    of_edges = blocks(e, "es").checkpoint()
    levels = sorted(r["level"] for r in of_edges.select("level").distinct().collect())  # doublings of the length: few
    c = clicks.select("slice_index", "orientation", *(F.col(p).cast("double").alias(p) for p in ("px", "py"))).filter(finite("px") & finite("py")).distinct()
    c = c.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("tx", tile(F.col("px"))).withColumn("ty", tile(F.col("py")))
    plan = _counted(blocks(c, "cs").join(of_edges, key))  # a row for each tile with both
    hot = plan.filter(F.col("cs") > HOT).select(*key)
    if not hot.isEmpty():
        c, e = _in_cells(c, e, hot, key, side, w)
        key = [*key, "sx", "sy"]
        plan = _counted(blocks(c, "cs").join(blocks(e, "es"), key))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    e = e.select(*key, "roi_id", "edge_idx", "ax", "ay", "bx", "by").join(plan, key).withColumn("eb", F.pmod(F.xxhash64("roi_id", "edge_idx"), F.col("es")).cast("int")).withColumn("cb", every("cs"))
    c = c.join(plan, key).withColumn("cb", F.pmod(F.xxhash64("px", "py"), F.col("cs")).cast("int")).withColumn("eb", every("es"))
    key = [*key, "cb", "eb"]

    def near(key: tuple, points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(edges):
            return pd.DataFrame({x: [] for x in [*place, "d", "roi_id"]})
        x, y = points["px"].to_numpy(float), points["py"].to_numpy(float)
        d, roi = _nearest(x, y, edges[["ax", "ay", "bx", "by"]].to_numpy(float).T, edges["roi_id"].to_numpy(np.int64), w)
        found = d < w
        return pd.DataFrame({"slice_index": key[0], "orientation": key[1], "px": x[found], "py": y[found], "d": d[found], "roi_id": roi[found]})

    kind = T.StructType([*c.select(*place).schema, T.StructField("d", T.DoubleType()), T.StructField("roi_id", T.LongType())])
    pairs = c.select(*key, "px", "py").groupBy(key).cogroup(e.select(*key, "roi_id", "ax", "ay", "bx", "by").groupBy(key)).applyInPandas(near, kind)
    best = pairs.groupBy(*place).agg(F.min(F.struct("d", "roi_id")).alias("m"))
    return clicks.join(best, place, "left").select(*clicks.columns, F.col("m.roi_id").alias("nearest"))


def edit_hit(clicks: DataFrame, vertices: DataFrame, outline: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """clicks(click_id, roi_id: the selected one, slice_index, orientation, px, py) -> action, target: its vertex, its
    whole outline, or else the selection of what is nearest (or nothing). The slice counts for the first two, not the
    orientation. With others, all regions' outlines, vertices and outline may be of the selected regions only."""
    on = vertices.select("roi_id", F.col("slice_index").alias("_slice")).distinct()
    own = clicks.join(on, "roi_id").filter("slice_index = _slice").select("click_id", "roi_id", "px", "py")
    v = nearest_vertex(own, vertices).select("click_id", "vertex_idx")
    e = nearest_edge(own, outline).select("click_id", "edge_idx")
    r = nearest_roi(clicks.select("click_id", "slice_index", "orientation", "px", "py"), outline if others is None else others).select("click_id", "nearest")
    j = clicks.join(v, "click_id", "left").join(e, "click_id", "left").join(r, "click_id", "left")
    action = F.when(F.col("vertex_idx").isNotNull(), "vertex").when(F.col("edge_idx").isNotNull(), "whole").otherwise("select")
    target = F.when(F.col("vertex_idx").isNotNull(), F.col("vertex_idx")).when(F.col("edge_idx").isNotNull(), F.col("roi_id")).otherwise(F.col("nearest"))
    return j.select("click_id", action.alias("action"), target.cast("long").alias("target"))


def double_click(clicks: DataFrame, outline: DataFrame) -> DataFrame:
    """Insert rows for a log: the clicked point after the selected ROI's nearest edge within FAR."""
    hit = nearest_edge(clicks, outline, FAR).filter("edge_idx IS NOT NULL")
    return hit.select("click_id", "roi_id", F.lit("insert").alias("op"), F.col("edge_idx").alias("idx"), F.col("px").alias("ex"), F.col("py").alias("ey"))


def hovered_delete(clicks: DataFrame, vertices: DataFrame) -> DataFrame:
    """Delete rows for a log: the selected ROI's nearest vertex within FAR; the fold refuses them below four points."""
    hit = nearest_vertex(clicks, vertices, FAR).filter("vertex_idx IS NOT NULL")
    return hit.select("click_id", "roi_id", F.lit("delete").alias("op"), F.col("vertex_idx").cast("int").alias("idx"))


def drags(moves: DataFrame) -> DataFrame:
    """moves(drag_id, seq, x, y) -> the vertex's last place, and the whole outline's shift: the sum of successive steps."""
    w = Window.partitionBy("drag_id").orderBy("seq")
    m = moves.withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w))
    return m.groupBy("drag_id").agg(F.max_by("x", "seq").alias("x"), F.max_by("y", "seq").alias("y"), F.coalesce(F.sum("dx"), F.lit(0.0)).alias("dx"), F.coalesce(F.sum("dy"), F.lit(0.0)).alias("dy"))


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column, z: Column) -> Column:
    """A square at the first corner: the shorter side on both axes, signs kept, 0 as plus."""
    side = F.least(F.abs(x2 - x1), F.abs(y2 - y1))
    sx, sy = x1 + F.when(x2 - x1 >= 0, side).otherwise(-side), y1 + F.when(y2 - y1 >= 0, side).otherwise(-side)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    return F.array(p(x1, y1), p(sx, y1), p(sx, sy), p(x1, sy))


def ellipse(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column, n: int = 64) -> Column:
    """n points around the box's middle, from the right, with half its sides as radii; the angles' cosines and sines are
    literals."""
    cx, cy, cz, rx, ry = (x1 + x2) / 2, (y1 + y2) / 2, (z1 + z2) / 2, F.abs(x2 - x1) / 2, F.abs(y2 - y1) / 2
    angles = [2 * math.pi * i / n for i in range(n)]
    round_ = F.array(*(F.struct(F.lit(math.cos(a)).alias("c"), F.lit(math.sin(a)).alias("s")) for a in angles))
    return F.transform(round_, lambda u: F.struct((cx + rx * u["c"]).alias("x"), (cy + ry * u["s"]).alias("y"), cz.alias("z")))


def rounded(value: Column, places: int) -> Column:
    """value to so many places, halves away from 0, in doubles; F.round goes by a decimal for each value."""
    v = value * 10.0**places
    near = F.rint(v)
    half = F.when(v - near == 0.5, 1.0).when(v - near == -0.5, -1.0).otherwise(0.0)
    away = F.when((half != 0) & ((v > 0) == (half > 0)), near + half).otherwise(near)
    return away / 10.0**places


def visible(views: DataFrame, rois: DataFrame) -> DataFrame:
    """views(session_id, slice_index, orientation, selected) x ROIs on that slice; handles for the selected one only."""
    j = views.join(rois.drop("session_id") if "session_id" in rois.columns and "session_id" not in views.columns else rois, [c for c in ("session_id", "slice_index", "orientation") if c in rois.columns and c in views.columns])
    return j.withColumn("handles", F.coalesce(F.col("selected") == F.col("roi_id"), F.lit(False)))


def listing(roi_id: Column, name: Column, slice_index: Column) -> Column:
    return F.format_string("[%d] %s  (slice %d)", roi_id.cast("long"), name, (slice_index + 1).cast("long"))


def rgb(color: Column) -> Column:
    """0..1 to 0..255, cut, not rounded."""
    return F.transform(color, lambda c: (c * 255).cast("int"))


def goto(rois: DataFrame, extents: DataFrame) -> DataFrame:
    """roi_id, orientation, slice_index and the extent of that orientation."""
    return rois.join(extents, ["series_id", "orientation"], "left").select("roi_id", "orientation", "slice_index", "low", "high")
