"""What reaches the scan: pushed filters, pruned columns, and no Python where none is needed."""

import io
from contextlib import redirect_stdout

import pytest

from sievewright import catalog
from sievewright.operators import clean
from sievewright.plans.config import Op

SF = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(("op", "pushed"), [
    (Op(op="filter", field="event_type", condition="equals", value="view"), "EqualTo(event_type,view)"),
    (Op(op="filter", field="event_type", condition="in", filter_values=("view", "click")), "In(event_type, [click,view])"),
    (Op(op="filter", field="event_type", condition="starts_with", value="v"), "StringStartsWith(event_type,v)"),
    (Op(op="drop_null", field="event_type"), "IsNotNull(event_type)"),
])
def test_filters_reach_the_scan(spark, op, pushed):
    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = plan_of(clean.apply_op(events, op).select("event_id", "event_type"))
    assert pushed in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


PYTHON = {"op_nfkc", "web_links", "web_records", "json_flatten", "json_diff", "fb_unique_suffix", "op_filter_equals", "con_regex_linear", "json_path_descent", "json_path_filter", "json_path_member", "json_path_slice", "json_to_csv", "page_decoded", "page_headings", "page_links_first", "page_list_links", "page_suggestions", "task_functions"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - PYTHON))
def test_built_in_plans(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert not any(w in plan for w in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct"))


@pytest.mark.parametrize("name", ["clean_events", "op_number_format", "op_filter_large", "op_number_large", "con_priority"])
def test_plans_compile(spark, name):
    """No stage falls back to interpretation because its code is too large."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
