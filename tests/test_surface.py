from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import surface
from lumenframe.plans.queries import QUERIES
from tests.test_nearest import _shuffled
from tests.twins import DATA


@pytest.fixture(scope="module")
def sphere(spark):
    n, c, r = 12, 5.5, 4.1
    cells = spark.range(n * n).select(F.lit(0).alias("series_id"), F.floor(F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).cast("int").alias("j"))
    v = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i - c) * (i - c) + (F.col("j") - c) * (F.col("j") - c) + (F.col("k") - c) * (F.col("k") - c) <= r * r, 1.0).otherwise(0.0))
    return cells.withColumn("vals", v).cache()


def test_closed_mesh(spark, sphere):
    points = surface.vertices(sphere).collect()
    tris = surface.triangles(surface.cells(sphere)).collect()
    ids = {(p.axis, p.i, p.j, p.k) for p in points}
    used = {tuple(v) for t in tris for v in (t.a, t.b, t.c)}
    assert len(ids) == len(points) and used == ids
    sides = Counter((tuple(p), tuple(q)) for t in tris for p, q in ((t.a, t.b), (t.b, t.c), (t.c, t.a)))
    assert max(sides.values()) == 1 and all((q, p) in sides for p, q in sides)  # closed, and turned one way
    assert len(ids) - len(sides) // 2 + len(tris) == 2


def test_every_case_is_closed_with_its_neighbours():
    table = surface.case_table()
    assert {code for code, _, _ in table} == set(range(1, 255))
    assert max(Counter(code for code, _, _ in table).values()) <= 6


def test_smoothing(spark, sphere):
    geometry = spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "series_id int, sx double, sy double, sz double")
    points = surface.positions(surface.vertices(sphere), geometry).cache()
    tris = surface.triangles(surface.cells(sphere))
    assert surface.smooth(points, tris, 0) is points

    def spread(df):
        d = F.sqrt(F.pow(F.col("x") - 5.5, 2) + F.pow(F.col("y") - 5.5, 2) + F.pow(F.col("z") - 5.5, 2))
        return df.agg(F.stddev(d).alias("s"), F.count("*").alias("n")).first()

    before, after = spread(points), spread(surface.smooth(points, tris, 6))
    assert before.n == after.n and after.s < before.s


def test_the_query_smooths_with_all_iterations(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(surface, "smooth", lambda points, tris, iterations=20, pass_band=0.001: asked.append((iterations, pass_band)) or points)
    QUERIES["mesh_smooth"](spark, DATA)
    assert asked == [(20, 0.001)]


def smoothed(points, tris, n):
    """The filter, vertex by vertex."""
    weight = surface._weights(n, 0.001)
    place = {tuple(p.v): (p.x, p.y, p.z) for p in points}
    near, uses = {v: set() for v in place}, Counter()
    for t in tris:
        for p, q in ((t.a, t.b), (t.b, t.c), (t.c, t.a)):
            near[tuple(p)].add(tuple(q))
            near[tuple(q)].add(tuple(p))
            uses[frozenset((tuple(p), tuple(q)))] += 1
    rim = {v for v in place if not near[v] or any(uses[frozenset((v, w))] == 1 for w in near[v])}

    def lap(at):
        return {v: (0.0,) * 3 if v in rim else tuple(at[v][c] - sum(at[w][c] for w in near[v]) / len(near[v]) for c in range(3)) for v in at}

    mix = lambda f, *tables: {v: tuple(f(*x) for x in zip(*(t[v] for t in tables))) for v in place}
    a = place
    b = mix(lambda x, y: x - 0.5 * y, a, lap(a))
    s = mix(lambda x, y: weight[0] * x + weight[1] * y, a, b)
    for q in range(2, n + 1):
        a, b = b, mix(lambda x, y, z: 2 * (x - 0.5 * y) - z, b, lap(b), a)
        s = mix(lambda x, y, q=q: x + weight[q] * y, s, b)
    return s


@pytest.mark.parametrize(("brick", "steps", "n"), [(4, 3, 7), (32, 5, 6), (5, 1, 3), (3, 3, 20)])
def test_bricks_and_halos_change_nothing(spark, sphere, brick, steps, n):
    geometry = spark.createDataFrame([(0, 1.0, 2.0, 0.5)], "series_id int, sx double, sy double, sz double")
    lines = sphere.filter("k < 9")  # the sphere is cut off: it has a rim
    points, tris = surface.positions(surface.vertices(lines), geometry).cache(), surface.triangles(surface.cells(lines)).cache()
    got = {tuple(r.v): (r.x, r.y, r.z) for r in surface.smooth(points, tris, n, brick=brick, steps=steps).collect()}
    want = smoothed(points.collect(), tris.collect(), n)
    assert got.keys() == want.keys()
    assert max(abs(x - y) for v in want for x, y in zip(got[v], want[v])) < 1e-9


def test_twenty_steps_are_four_shuffles(spark):
    """Of the state; the neighbours are gathered once before."""
    plan = QUERIES["mesh_smooth"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 4 and "Generate" in plan


def test_rows_far_from_the_surface_are_not_shuffled(spark, monkeypatch):
    """A small ball in a large volume: only the tiles around it go on, and the surface is the same as without skipping."""
    n, c = 96, (20.0, 33.0)
    grid = spark.range(n * n).select(F.lit(0).alias("series_id"), F.floor(F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).cast("int").alias("j"))
    ball = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when((i - 8) * (i - 8) + (F.col("j") - c[0]) * (F.col("j") - c[0]) + (F.col("k") - c[1]) * (F.col("k") - c[1]) <= 30, 1.0).otherwise(0.0))
    lines = grid.withColumn("vals", ball).cache()
    assert surface.near_surface(lines).count() < 0.2 * n * n
    got = [sorted(map(str, f(lines).collect())) for f in (surface.vertices, surface.cells)]
    monkeypatch.setattr(surface, "TILES", 0)  # nothing is broadcast: nothing is skipped
    assert surface.near_surface(lines) is lines
    assert [sorted(map(str, f(lines).collect())) for f in (surface.vertices, surface.cells)] == got and len(got[0]) > 100


def test_a_vertex_is_shuffled_a_few_times(spark):
    """With its triangles and its copies in halos; no brick without vertices gets any below 0."""
    before = _shuffled(spark)
    n = len(QUERIES["mesh_smooth"](spark, DATA).collect())
    assert n > 1000 and _shuffled(spark) - before < 10 * n


def test_grid_indices_below_0_are_refused(spark):
    v = "struct<axis:int,i:int,j:int,k:int>"
    points = spark.createDataFrame([(0, (0, -1, 0, 0), 0.0, 0.0, 0.0)], f"series_id int, v {v}, x double, y double, z double")
    with pytest.raises(Exception, match="grid indices"):
        surface.smooth(points, spark.createDataFrame([], f"series_id int, a {v}, b {v}, c {v}"), 3).collect()
