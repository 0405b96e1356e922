"""What the plans look like, how the packages depend on each other, and the registry."""

import sys
import ast
from pathlib import Path

import pytest

import __spark_entry__ as driver
from listinglake.catalog import ORACLES, QUERIES
from tools.check import compare, database

ROOT = Path(__file__).resolve().parents[1] / "listinglake"
SAMPLE = ["current_gigs", "new_or_changed", "effective_class", "compact", "lookalikes", "page_rows", "cost_report", "crowded_bulk", "json_tolerant", "date_ordinal"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_products_and_no_python(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "MapInPandas", "MapInArrow"):
        assert node not in plan, node


def test_verdicts_aggregate_by_hash(spark, sf):
    plan = plan_of(QUERIES["effective_class"](spark, sf))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_date_ranges_compile(spark, sf):
    """Every stage's generated code is within what the compiler takes, so none falls back."""
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # stages are formed at once
    try:
        stages = debug.codegenStringSeq(QUERIES["date_range"](spark, sf)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert stages.size() > 0
    assert all(0 < stages.apply(i)._3().maxMethodCodeSize() < 65_536 for i in range(stages.size()))


def test_scans_read_only_what_they_need(spark, sf):
    plan = QUERIES["last_scraped"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "ReadSchema" in scan and "description" not in scan


def imports_of(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_layers():
    """Steps do not import each other, and nothing below reaches up into plans or the catalog."""
    steps = {"scrape", "classify", "render"}
    for path in (ROOT / "plans").glob("*.py"):
        if path.stem in steps:
            assert not {f"listinglake.plans.{s}" for s in steps - {path.stem}} & set(imports_of(path))
    for layer in ("functions", "sources", "operators", "streaming"):
        for path in (ROOT / layer).rglob("*.py"):
            assert not [m for m in imports_of(path) if m.startswith(("listinglake.plans", "listinglake.catalog"))], path


def test_entry(spark):
    assert driver.entry(spark).columns == ["date", "title", "venue", "url", "image_url"]


def test_registry():
    more = set(driver.queries()) - set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and all(n == "pipeline" or n.startswith("op") for n in more)
    assert set(ORACLES) <= set(driver.oracle_sql()) <= set(driver.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("gone", ["corpus_pipeline", "listinglake.llm.queries", "listinglake.llm"])
def test_registry_without_the_llm_subpackage(monkeypatch, gone):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("listinglake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    assert set(driver.queries()) == set(QUERIES) and set(driver.oracle_sql()) == set(ORACLES)


def test_nothing_else_imports_the_llm_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [m for m in imports_of(path) if m.startswith("listinglake.llm")], path


@pytest.mark.parametrize("name", ["current_gigs", "class_status", "page_rows", "chk_shared_desc", "dom_text", "date_group_cards"])
def test_against_sql(spark, sf, name):
    ok, note = compare(spark, database(sf), sf, name)
    assert ok, note


