"""How finely rows are dealt out where a step works long on them or holds a part of them in memory."""

import pytest

from recordloom.plans import catalog
from recordloom.sources.stored import FINER

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_evidence", "q_predicates"])
def test_a_small_file_is_many_tasks(spark, name):
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() == 4 * FINER


@pytest.mark.parametrize("name", ["q_block_records", "q_registry_all_faults", "q_mandatory_roots"])
def test_rows_that_are_sorted_in_memory_are_dealt_out_finer(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f", {4 * FINER}), REPARTITION_BY_NUM" in plan


def test_pages_are_parsed_once(spark):
    plan = catalog.QUERIES["q_page_shapes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_storeys_are_read_once_for_roots(spark):
    assert len({f.rsplit("/", 2)[-2] for f in catalog.QUERIES["q_branch_outcomes"](spark, SF).inputFiles()}) == 1
