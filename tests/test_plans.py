"""Plans read the columns they need, push filters to the scan, and join on keys."""

import os
import re

import pytest

from fathom.plans import catalogue

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables are not here")
LAZY = ["coord_median", "class_histogram", "cell_lookup", "percentile_by_code", "class_edges", "survey_agreement", "orientation_sweep", "raster_iou", "nearest_palette", "pip_holes", "island_anti", "morph_close", "ring_metrics", "taubin", "gps_gate_batch", "tile_cover", "bilinear_sample", "polygon_burn", "stable_interior"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|BatchEvalPython", plan(catalogue.QUERIES[name](spark, D)))


def test_columns_and_filters(spark):
    p = plan(catalogue.QUERIES["survey_agreement"](spark, D))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all(len(s.split(",")) <= 4 for s in schemas)
    f = plan(catalogue.C.raster(spark, D).where("x = 3"))
    assert "l_orderkey" in f and "l_comment" not in f
    q = plan(catalogue.C.table(spark, D, "lineitem").where("l_quantity > 30").select("l_orderkey"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(l_quantity,30", q)
    assert "WindowGroupLimit" in plan(catalogue.QUERIES["longest_rings"](spark, D))


def test_point_depth_is_a_keyed_join(spark):
    p = plan(catalogue.QUERIES["point_depth"](spark, D))
    assert re.search("SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", p) and "CartesianProduct" not in p
