"""Plans: what is pruned, what is shuffled, and that nothing but one-row tables meets without a key."""

import re

import pytest

from lodegraph import session
from lodegraph.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "ev_metrics")
    assert "IsNotNull" in text and not re.search(r"ReadSchema: [^\n]*l_comment|ReadSchema: [^\n]*l_extendedprice", text)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderkey", plan(spark, "src_qa_split"))


@pytest.mark.parametrize("name", ["vss_topk", "so_dedup_last", "ev_metrics", "jn_expand", "rr_score", "gr_pop", "an_failure_causes"])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_dedup_sums_before_it_shuffles(spark):
    assert re.search(r"partial_max_by", plan(spark, "so_dedup_last"))


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(spark, "vss_topk")
    assert "MapInArrow" in text and "WindowGroupLimit" in text


def test_scalar_functions_stay_in_the_jvm(spark):
    for name in ("fn_parse_entities", "an_failure_causes", "cand_choice_parse", "fn_answer_cleanup", "src_jsonl_results"):
        assert not re.search("Python|Pandas|Arrow", plan(spark, name)), name


def test_tasks_stay_small_as_tables_grow(spark, tmp_path):
    """Shuffles start with partitions in proportion to the tables, and neither they nor files give a task much."""
    keys = [f"spark.sql.{k}" for k in ("adaptive.advisoryPartitionSizeInBytes", "files.maxPartitionBytes", "adaptive.coalescePartitions.initialPartitionNum")]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        with open(tmp_path / "lineitem.parquet", "wb") as f:
            f.truncate(1 << 30)
        QUERIES["ev_metrics"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(keys[2], None) is None and [int(spark.conf.get(k)) for k in keys[:2]] == [16 << 20, 32 << 20]
        session.small_tasks(spark, str(tmp_path))
        assert "hashpartitioning(_k, 256)" in re.sub(r"k#\d+L", "_k", spark.range(9).selectExpr("id % 3 AS k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString())
        spark.conf.set(keys[0], "8m")
        session.small_tasks(spark, str(tmp_path))
        assert spark.conf.get(keys[0]) == "8m"
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
