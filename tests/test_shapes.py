import math
import random

from pyspark.sql import functions as F

from lumenframe.operators import rois


def test_rounding_is_halves_away_from_zero(spark):
    """As C's round, also just below a half and for halves of both signs, without a decimal for each value."""
    r = random.Random(1)
    values = [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, -0.49999999999999994, 0.0, 1e17, *(r.uniform(-99, 99) for _ in range(200))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", rois.rounded(F.col("v"), 0).alias("r"))
    whole = lambda v: math.copysign(math.floor(abs(v)) + (abs(v) - math.floor(abs(v)) >= 0.5), v)
    assert [(x.v, x.r) for x in rows.collect()] == [(v, whole(v)) for v in values]


def test_an_ellipse_computes_no_angles(spark):
    plan = spark.range(1).select(F.explode(rois.ellipse(*(F.col("id") * i for i in range(6)))).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "COS" not in plan.upper() and "SIN(" not in plan.upper()
