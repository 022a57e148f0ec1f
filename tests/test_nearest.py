import random

import pytest

from lumenframe.operators import rois
from lumenframe.plans.queries import QUERIES
from tests.twins import DATA

CLICKS = "click_id long, slice_index int, orientation int, px double, py double"
EDGES = "roi_id long, slice_index int, orientation int, edge_idx int, ax double, ay double, bx double, by double"


def _shuffled(spark):
    """Records written to shuffles so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_long_edges_in_a_hot_tile_are_shuffled_a_few_times(spark):
    """As many clicks as edges at a hundred places: more edges than a block holds, each as long as the slice is wide."""
    r = random.Random(5)
    edges = [(i, 1, 2, 0, *(r.uniform(0, 60) for _ in range(4))) for i in range(3000)]
    clicks = [(i, 1, 2, float(i % 10 * 6), float(i // 10 % 10 * 6)) for i in range(3000)]
    before = _shuffled(spark)
    found = rois.nearest_roi(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(edges, EDGES), block=1000).collect()
    assert len({(c.px, c.py) for c in found}) == 100 and len(found) == 3000 and all(c.nearest is not None for c in found)
    assert _shuffled(spark) - before < 10 * 3000


def test_edges_and_clicks_that_are_nowhere_hide_no_others(spark):
    nan, inf = float("nan"), float("inf")
    edges = [(1, 1, 2, 0, 1.0, 1.0, 3.0, 1.0), (2, 1, 2, 0, nan, 1.0, 3.0, 1.0), (3, 1, 2, 0, 1.0, 1.0, inf, 1.0), (4, 1, 2, 0, 0.0, 2.0, 1e30, 2.0)]
    clicks = [(1, 1, 2, 2.0, 1.25), (2, 1, 2, nan, 1.0), (3, 1, 2, 2.0, inf), (4, 1, 2, None, 1.0), (5, 1, 2, 500.0, 3.0), (6, 1, 2, 2.0, 1.25)]
    got = rois.nearest_roi(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(edges, EDGES))
    assert sorted((c.click_id, c.nearest) for c in got.collect()) == [(1, 1), (2, None), (3, None), (4, None), (5, 4), (6, 1)]


@pytest.mark.parametrize(("query", "times"), [("edit_hit", 4), ("nearest_roi", 2.5)])
def test_the_given_rows_are_shuffled_once(spark, query, times):
    """And the edges once more, to their tiles; edit_hit's clicks and picked regions come on top."""
    before = _shuffled(spark)
    QUERIES[query](spark, DATA).collect()
    assert _shuffled(spark) - before < times * spark.read.parquet(f"{DATA}/lineitem.parquet").count()
