"""Each registered query against its SQL."""

import datetime

import pytest

from quern.plans import catalogue
from tests.oracle import same

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf_dir, name):
    same(catalogue.queries()[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() >= 0


def test_entry_is_importable_and_flagship_has_rows(spark):
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["order__customer__nation__n_name", "revenue"]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.queries()["page_values"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = catalogue.queries()["count_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,50.0)" in plan and "EqualTo(event_type,click)" in plan


def test_range_agg_rounds_seconds_as_its_sql(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(u, k, None if s is None else at + datetime.timedelta(seconds=s)) for u, k, s in (
        (1, 1, 0.4), (1, 2, 3600.6), (2, 3, 0.6), (2, 4, 3601.4), (3, 5, 0.5), (3, 6, 3601.0), (4, 7, 1.5), (4, 8, 3602.5), (5, 9, 7.0), (5, 10, None), (6, 11, None), (6, 12, None), (7, 13, 5.0), (7, 14, 5.0), (7, 15, 9000.0))]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/written")
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "events.parquet")
    same(catalogue.queries()["range_agg"](spark, str(tmp_path)), ORACLES["range_agg"], str(tmp_path))
