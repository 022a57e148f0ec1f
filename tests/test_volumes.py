import pytest

from lumenframe.plans.queries import ORACLES, QUERIES
from tests.twins import database, same


@pytest.mark.parametrize("name", ["volume_ingest", "volume_slice"])
def test_volumes_that_lack_rows(spark, tmp_path, name):
    """The last slice is cut off, rows and a slice are lacking, rows differ in length, values and a whole row are null."""
    rows = [(v, None if v == 205 else [None if v == 3 and i == 1 else float(v + i) for i in range(5 if v == 7 else 3)]) for v in range(547) if v not in (12, 40, 49) and v // 10 != 22]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], database(str(tmp_path))) > 0
