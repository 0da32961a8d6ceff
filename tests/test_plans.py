"""Plans that must keep their shape, whatever the size of the data."""

import re

from latticeflow.functions.geometry import Box
from latticeflow.operators import graph, region, resample
from latticeflow.plans import lattice
from latticeflow.plans.queries import QUERIES
from tests.conftest import DATA


def physical(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    lattice.vox(spark, DATA).withColumn("extra", lattice.F.lit("x")).write.parquet(path)
    text = physical(region.read(spark.read.parquet(path), Box.of((10, 5, 1), (50, 9, 3))).select("x", "v"))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)[1]
    assert all(f"{op}({a}," in pushed for a in "xyz" for op in ("GreaterThanOrEqual", "LessThan"))
    assert "extra" not in re.search(r"ReadSchema: struct<([^>]*)>", text)[1]


def test_one_shuffle_each(spark):
    """Grid group-bys aggregate before their one shuffle; overlays never compare all chunks."""
    v = lattice.vox(spark, DATA)
    text = physical(resample.downsample(v, 2, "max"))
    assert text.count("Exchange") == 2 and "partial_max" in text  # the lattice's own and the cells'
    for name in ("merge_overlay", "content_equal", "mask_filter", "affine_rotate90", "synapse_pairs", "for_zipped_chunks"):
        text = physical(QUERIES[name](spark, DATA))
        assert not re.search("CartesianProduct|NestedLoop", text), name


def test_no_single_partition_windows(spark):
    for name in ("path_length", "asof_join", "tree_degree", "downsample_mode", "user_times_pivot"):
        assert "SinglePartition" not in physical(QUERIES[name](spark, DATA)), name


def test_distance_join_is_an_equi_join(spark):
    text = physical(graph.pairs_within(lattice.nodes(spark, DATA), 2.0))
    assert re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join \[kx", text)
