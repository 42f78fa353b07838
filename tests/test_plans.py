"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import dedupe as d
from flowsieve.operators.ordering import chronological_split, dense_index
from flowsieve.operators.sequences import mean_forecast
from flowsieve.plans import catalog
from flowsieve.plans.event_flows import event_flows, event_view
from flowsieve.session import own_tables, release_tables, shared_dir, written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedupe_global_exact", "dedupe_scoped_exact", "dedupe_ttl", "dedupe_two_stage"])
def test_verdicts_need_no_window_and_no_single_task(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    assert "Window" not in text and "SinglePartition" not in text and "Cartesian" not in text
    assert "partial_min" in text  # combined before the shuffle


def test_time_order_has_no_single_task(spark, sf):
    flows = event_flows(spark, sf).select("seq", "ts", "value", "label")
    ordered, n = dense_index(flows, ["ts", "seq"])
    rows = mean_forecast(chronological_split(ordered, n), ["value"])
    assert "SinglePartition" not in plan(rows)


def test_scan_reads_only_what_it_needs(spark, sf):
    text = plan(event_view(spark, sf).select("tenant"))
    schema = text[text.index("ReadSchema") :]
    assert "user_id" in schema and "props" not in schema and "value" not in schema


def test_filters_reach_the_scan(spark, sf):
    text = plan(d.dedupe_none(event_view(spark, sf)).where(F.col("seq") > 10))
    assert "GreaterThan(event_id,10)" in text


def test_written_tables_can_be_released(spark):
    table = written(spark.range(5), "test")
    path = table.inputFiles()[0]
    assert table.count() == 5 and release_tables(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_tables_of_a_block_go_with_it_even_if_it_fails(spark):
    earlier = written(spark.range(3), "earlier")
    with pytest.raises(ZeroDivisionError), own_tables(spark):
        path = written(spark.range(5), "inside").inputFiles()[0]
        1 / 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    assert earlier.count() == 3


def test_a_block_owns_only_the_tables_of_its_thread(spark):
    import threading

    from flowsieve import session

    other = []
    with own_tables(spark):
        thread = threading.Thread(target=lambda: other.append(written(spark.range(4), "other")))
        thread.start()
        thread.join()
        with own_tables(spark):
            written(spark.range(1), "inner")
        outer = written(spark.range(2), "outer")
        assert outer.count() == 2 and len(session._blocks.open) == 1
    assert other[0].count() == 4 and session._blocks.open == []


class _Session:
    """Just what `shared_dir` asks of a session."""

    def __init__(self, setting, master, application_dir=None):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext, self.master, self.dir = self, master, application_dir

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


def test_shared_folder_comes_from_the_session():
    assert shared_dir(_Session("hdfs://shared/", "yarn")) == "hdfs://shared"
    assert shared_dir(_Session(None, "yarn", "hdfs://own")) == "hdfs://own"
    with pytest.raises(ValueError):
        shared_dir(_Session(None, "yarn"))
    local = _Session(None, "local[2]")
    assert shared_dir(local) == shared_dir(local) == local.dir
