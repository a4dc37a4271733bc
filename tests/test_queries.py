"""Registered queries against reference SQL, and the shape of their plans."""

import os
import re

import __spark_entry__ as entry
import pytest

from compare import compare, connect
from conftest import DATA
from reviewlake.plans import catalog

SOME = (
    "clean_reviews clean_text features validation_gate anomaly_report anom_iqr bias_report balance_classes "
    "stratified_split ovr_auc fairness_report critical_keywords aspect_sentiment triage reply_tone quality_batch "
    "running_confidence review_pages_flatten"
).split()
KEYS = sorted(catalog.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_is_known():
    assert len(catalog.queries()) == 137 and set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_reference_sql(spark, con, key):
    assert compare(spark, con, DATA, entry.queries()[key], entry.oracle_sql()[key]) is None


def plan(spark, key):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    return entry.queries()[key](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["anom_short", "stratified_split", "running_confidence", "roc_points", "balance_classes"])
def test_windows_are_partitioned_and_bounded(spark, key):
    text = plan(spark, key)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    for window in re.findall(r"Window \[.*windowspecdefinition\((.*?)specifiedwindowframe", text):
        assert not window.strip().startswith("(") and "," in window
    if key == "anom_short":
        assert "Partial" in text and "WindowGroupLimit" in text


def test_triage_does_not_shuffle(spark):
    text = plan(spark, "triage")
    assert "hashpartitioning" not in text and "SinglePartition" not in text and "Window" not in text
