"""Queries reach the whole of tables that are larger than the smallest ones."""

import duckdb
import numpy as np
import pytest
from oracle import same

from terrace.operators import focal
from terrace.plans import catalog

SF = "/root/testdata/sf0.1"


def _nir():
    e = duckdb.sql(f"SELECT vec_id, embedding[14] AS v FROM '{SF}/embeddings.parquet' ORDER BY 1").df()
    return np.floor(np.abs(e["v"].astype(float).to_numpy()) * 10000).reshape(-1, 25) + 1


def test_resample_nearest_whole(spark):
    nir = _nir()
    got = catalog.QUERIES["resample_nearest"](spark, SF).toPandas()
    assert len(got) == 4 * nir.size and len(got[["row", "col"]].drop_duplicates()) == len(got)
    assert (got["nir"] == nir[got["row"] // 2, got["col"] // 2]).all()


def test_resample_bilinear_whole(spark):
    nir = _nir()
    got = catalog.QUERIES["resample_bilinear"](spark, SF).toPandas()
    assert len(got) == 4 * nir.size
    for r in got.itertuples():
        y, x = (r.row + 0.5) / 2 - 0.5, (r.col + 0.5) / 2 - 0.5
        near = [(i, j, (1 - abs(y - i)) * (1 - abs(x - j))) for i in (int(np.floor(y)), int(np.floor(y)) + 1) for j in (int(np.floor(x)), int(np.floor(x)) + 1)]
        near = [(nir[i, j], w) for i, j, w in near if 0 <= i < len(nir) and 0 <= j < 25]
        assert r.nir == pytest.approx(sum(v * w for v, w in near) / sum(w for _, w in near), abs=2e-5)


def test_one_vs_rest_whole(spark):
    got = catalog.QUERIES["rf_one_vs_rest"](spark, SF.replace("sf0.1", "sf0.001")).toPandas()
    assert len(got) == 500 and {len(s) for s in got["scores"]} == {10} and set(got["cls"]) > {0, 1, 2}
    assert all(s[c] == max(s) == f for s, c, f in zip(got["scores"], got["cls"], got["confidence"]))


@pytest.mark.parametrize("name", ["raster_there_and_back", "raster_window"])
def test_rasters_of_more_rows_than_the_smallest(spark, tmp_path, name):
    d = str(tmp_path)
    # Rows up to 4515: beyond 1500, and in three tiles of 2048.
    duckdb.sql(f"COPY (SELECT * REPLACE (o_orderkey + 150000 * k AS o_orderkey) FROM '{SF.replace('sf0.1', 'sf0.001')}/orders.parquet', (SELECT unnest([0, 1, 3]) AS k)) TO '{d}/orders.parquet'")
    same(catalog.QUERIES[name](spark, d), catalog.ORACLES[name], d)


def test_distances_read_a_column_once(spark):
    px = spark.range(3000).selectExpr("id % 1500 AS row", "id div 1500 AS col")
    done = focal.distance_to(px, px["row"] % 700 == 5)
    assert "unboundedfollowing" not in done._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r.row, r.col): r.distance for r in done.collect()} == {(i, j): 10.0 * min(abs(i - f) for f in (5, 705, 1405)) for i in range(1500) for j in range(2)}


def test_classes_alike_outside_segments_stay_in_order(spark, tmp_path):
    levels = [[(0.0137 + 0.00731 * ((7 * i + k) % 13)) if k not in (0, 9) else 0.11145 + 0.0001 * (i % 97) for k in range(16)] for i in range(500)]
    spark.createDataFrame(list(enumerate(levels)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "e"))
    duckdb.sql(f"COPY (SELECT * FROM '{tmp_path}/e/*.parquet') TO '{tmp_path}/embeddings.parquet'")
    same(catalog.QUERIES["object_confusion_blend"](spark, str(tmp_path)), catalog.ORACLES["object_confusion_blend"], str(tmp_path))
