"""Every registered query equals its SQL form; queries without one return rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    assert check.compare(spark, con, name, SF, []) is None


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == [
        "post_id", "topic_name", "cluster_id", "text", "engagement", "lr_score", "pool_rn",
    ]
    per_topic = {r.topic_name: r["count"] for r in result.groupBy("topic_name").count().collect()}
    assert per_topic and set(per_topic.values()) == {20}
