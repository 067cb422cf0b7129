import pytest

import __spark_entry__ as contract
from oracle import statements
from runwarden.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    own = set(catalog.queries())
    assert own == set(statements())
    assert own <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["stream_task_logs", "stream_signals", "stream_late_share", "stream_telemetry"])
def test_streams_agree_with_batch(spark, name):
    streamed = contract.queries()[name](spark, FOLDER)
    if name == "stream_task_logs":
        assert streamed.count() == contract.queries()["task_log_explode"](spark, FOLDER).count()
    elif name == "stream_signals":
        assert sorted(streamed.collect()) == sorted(contract.queries()["incidents"](spark, FOLDER).collect())
    elif name == "stream_late_share":
        total = streamed.groupBy().sum("n", "late").collect()[0]
        share = contract.queries()["pct_late"](spark, FOLDER).collect()[0][0]
        assert total[0] == 1000 and total[1] / total[0] == pytest.approx(share, abs=1e-6)
    else:
        assert streamed.groupBy().sum("rows_in").collect()[0][0] == 1000
