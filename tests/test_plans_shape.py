"""Physical-plan guards: pruning, no Python in the core, no cartesian joins."""
import re

import pytest

from pagewise.queries import REGISTRY

from conftest import SF001

CORE = ["extract_outlines", "build_cell_dataset", "build_heading_dataset", "label_cells", "spans_to_lines",
        "outline_metrics", "roc_auc", "threshold_sweep", "stratified_split", "random_oversample", "detect_language"]


@pytest.mark.parametrize("name", CORE)
def test_plan_shape(spark, name):
    plan = REGISTRY[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    for schema in re.findall(r"ReadSchema: (struct<[^ ]*>)", plan):
        if "text:string" in schema and "doc_id" in schema:
            assert schema in ("struct<doc_id:bigint,text:string>", "struct<doc_id:bigint,text:string,lang:string>",
                              "struct<doc_id:bigint,lang:string,text:string>"), schema


def test_spans_are_not_shuffled(spark):
    """Documents are spread before their words become rows; lines are the same."""
    from pagewise import queries as Q
    got = REGISTRY["spans_to_lines"](spark, SF001)
    plan = got._jdf.queryExecution().executedPlan().toString()
    parts = Q.SPREAD * Q.documents(spark, SF001).rdd.getNumPartitions()
    assert [int(n) for n in re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, (\d+)\)", plan)] == [parts]
    assert plan.count("Exchange ") == 1 and plan.rindex("Generate") < plan.index("Exchange ")
    want = Q.B.spans_to_lines(Q.FX.spans(Q.documents(spark, SF001))).withColumn("size", Q.F.round("size", 9))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
