"""Plans: what is read, how often rows are shuffled, and no joins of all with all."""

import re

import pytest

import __spark_entry__ as entry
from tracksmith.operators import measures as m
from tracksmith.operators import preparing as pr
from tracksmith.operators import statistics as us
from tracksmith.plans.reference import traj


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange ", plan(df)))


@pytest.mark.parametrize("name,columns", [("p4_found", "user_id,datetime,start,end"), ("us2_count_records", "user_id")])
def test_only_needed_columns_are_read(spark, data, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()[name](spark, data)))
    assert {",".join(c.split(":")[0] for c in r.split(",")) for r in read if r} == {columns}


def test_heavy_keys_read_the_table_once(spark, data):
    from tracksmith.operators.hotkeys import key_totals
    from tracksmith.plans.preparation import STOPS
    from tracksmith.sources.tables import table

    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(key_totals(table(spark, data, STOPS), "user_id")))
    assert read == ["user_id:bigint"]
    assert STOPS not in plan(entry.queries()["p2_found"](spark, data))


def test_joins_of_grown_tables_are_not_broadcast(spark, data):
    """What the planner broadcasts on small data turns into sort-merge joins where tables are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "0")
    try:
        names = ["p1_found", "p4_found", "p6_found", *(n for n in ("p5_found", "p9_found", "p10_found") if n in entry.queries())]
        for name in names:
            assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, data)), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p6_found", "p7_found", "im17_match_lengths", "sp7_layer", "pd7_markov_predict", "mm8_activity_areas", "ta1_overlap"])
def test_nothing_is_joined_all_with_all(spark, data, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(entry.queries()[name](spark, data)))


def test_shuffles(spark, data):
    t = traj(spark, data)
    # windows by user share one shuffle
    assert exchanges(m.jump_lengths(t)) == 1
    assert exchanges(pr.next_location_sequence(t)) == 1
    assert exchanges(m.waiting_times(t)) == 1
    assert exchanges(m.self_transitions(t)) == 1
    assert exchanges(us.groupwise_expansion(t, "v")) == 1
    assert exchanges(us.count_records(t)) == 1
    # one to bring a user's steps together on the map side's counts, one to put them in order
    assert exchanges(entry.queries()["p4_found"](spark, data)) == 2
    assert exchanges(m.flows(t)) == 2


def test_filter_on_users_reaches_the_scan(spark, data):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(user_id,3\)", plan(m.jump_lengths(traj(spark, data)).where("user_id = 3")))
