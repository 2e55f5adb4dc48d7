"""Plans that scale: filters and columns reach the scan, joins have keys, Python only where it is meant."""

import re

import pytest

from loomgraph.plans import QUERIES

D = "/root/testdata/sf0.001"
#: Queries that may run Python.
PYTHON = {"sage_mean", "motif_fusion", "concat_vectors", "project_vicuna_2layer", "project_vicuna_2layermh", "project_vicuna_2layersh", "project_2_layer_mlp", "nc_generic", "nc_cora", "nc_pubmed", "nc_arxiv", "nc_products", "knn8", "knn8_index", "motif_network", "ocs_walk", "ocs_walk_large", "ocs_sequence", "emd", "closest_dataset", "closest_voted", "attention_pool", "pairwise_cosine", "semi_loss", "encode_texts", "balance_chunks"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_join_without_keys(spark, name):
    text = plan(QUERIES[name](spark, D))
    assert name in PYTHON or not re.search("Python|Pandas|Arrow", text)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["scan_vectors"](spark, D))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text
    text = plan(QUERIES["split_filter"](spark, D))
    assert "embedding" not in re.search(r"FileScan parquet \[vec_id[^\n]*", text)[0].split("Batched")[0]
    text = plan(spark.read.parquet(f"{D}/orders.parquet").where("o_orderkey = 7").select("o_custkey"))
    assert "EqualTo(o_orderkey,7)" in text


def test_no_window_holds_a_whole_table(spark):
    for name in ("relabel", "csr_ptr", "block_shard", "round_robin", "slice_rows", "shuffle_hash", "length_batches", "pad_batch"):
        text = plan(QUERIES[name](spark, D))
        assert "SinglePartition" not in text, name
