"""Shapes of the physical plans that matter at scale."""

import re

import pytest

from catalog.fixtures import load_inputs, table
from pflegetakt import Inputs, Staffing
from pflegetakt.operators.rows import match_prefix
from pflegetakt.plans.patient_days import valid_stays
from pflegetakt.settings import Settings

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("stays", "classifications", "controls", "wards", "newborns", "night")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Inputs as Parquet tables, as in production, with no data side small enough to broadcast."""
    folder = tmp_path_factory.mktemp("stored")
    inputs = load_inputs(spark, SF_DIR)
    for name in TABLES:
        getattr(inputs, name).write.parquet(f"{folder}/{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Above the three control tables, below all others.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
    yield Staffing(Inputs(**{n: spark.read.parquet(f"{folder}/{n}") for n in TABLES}))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def final_plan(frame):
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("\n+- == Initial Plan ==")[0]


def test_flagship_plan(stored):
    plan = final_plan(stored.monthly_report())
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    # One pass over the patient-days: a window in each direction of the case, on one shuffle.
    assert len(re.findall(r"Window \[[^\n]*windowspecdefinition\(scan_key", plan)) == 2
    assert len(re.findall(r"- Exchange hashpartitioning\(scan_key#\d+, \d+\)", plan)) <= 2  # and the newborn list
    # Ward means are windows over sums by ward and day.
    assert len(re.findall(r"- Exchange hashpartitioning\(ward#\d+, tag#\d+, kind", plan)) == 1


def test_windows_of_a_case_share_one_shuffle(stored):
    plan = final_plan(stored.filled)
    assert len(re.findall(r"- Exchange hashpartitioning\(scan_key", plan)) == 1
    assert plan.count("Window [") + plan.count("Window(") == 2


def test_classifications_join_reuses_the_patient_day_shuffle(stored):
    plan = final_plan(stored.attached)
    # Days once by patient and day; classifications by text, then by day.
    by_day = re.findall(r"- Exchange hashpartitioning\(pid_key#\d+, tag#\d+, \d+\)", plan)
    by_text = re.findall(r"- Exchange hashpartitioning\(pid_key#\d+, datum#\d+, \d+\)", plan)
    assert (len(by_day), len(by_text)) == (2, 1), plan


def test_stays_are_cut_before_they_become_days(stored):
    plan = final_plan(stored.master_days)
    assert "partial_max_by" in plan
    # No aggregate and no shuffle knows a day: stays are expanded last.
    assert not re.search(r"(Aggregate|Exchange)[^\n]*tag#", plan)
    assert len(re.findall(r"- Exchange", plan)) == 3


def test_filters_and_columns_reach_the_scan(stored):
    plan = final_plan(valid_stays(stored.inputs.stays, Settings()).select("case_key"))
    assert "IsNotNull(ward)" in plan
    assert re.search(r"GreaterThanOrEqual\(begin_ts,2024-01-01", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "pid" not in schema and "ord" not in schema


def test_prefix_filter_stays_in_the_scan_stage(spark):
    events = table(spark, SF_DIR, "events").select("event_type", "event_id")
    plan = final_plan(match_prefix(events, "^c"))
    assert "Exchange" not in plan
