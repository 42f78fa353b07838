"""Injected duplicates, synthetic flows and the configuration search."""

import pytest
from pyspark.sql import functions as F

from flowsieve.functions.records import flow_view
from flowsieve.operators import report as r
from flowsieve.operators.dedupe import dedupe_global_exact
from flowsieve.operators.report import dedupe_stats
from flowsieve.operators.workload import duplicate_pressure, synthetic_flows
from flowsieve.plans import search
from flowsieve.plans.event_flows import event_view


def test_pressure_adds_an_exact_number_of_copies(arrivals):
    df = arrivals([("t", f"u{i}") for i in range(101)])
    loaded = duplicate_pressure(df, 0.5)
    assert loaded.count() == 151
    assert sorted(x["seq"] for x in loaded.collect()) == list(range(151))
    assert dedupe_stats(dedupe_global_exact(loaded)).first()["duplicates"] == 50
    again = [x["origin"] for x in duplicate_pressure(df, 0.5).orderBy("seq").collect()]
    assert again == [x["origin"] for x in loaded.orderBy("seq").collect()]


def test_pressure_bounds(arrivals):
    df = arrivals([("t", "a")])
    assert duplicate_pressure(df, None) is df and duplicate_pressure(df, 0.0) is df
    assert duplicate_pressure(df.where("seq < 0"), 0.5).count() == 0
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            duplicate_pressure(df, bad)


@pytest.mark.parametrize("bursty", [False, True])
@pytest.mark.parametrize("n", [40, 3000])
def test_synthetic_flows_have_the_asked_size(spark, bursty, n):
    numbers = spark.range(n).withColumnRenamed("id", "i")
    flows = synthetic_flows(numbers, n, 0.5, bursty)
    assert flows.count() == n
    assert sorted(x["seq"] for x in flows.select("seq").collect()) == list(range(n))
    ids = flows.select("_id").distinct().count()
    assert ids == n // 2 if not bursty else 0 < ids <= n // 2
    lengths = flows.select(F.min(F.col("Total Length of Fwd Packets").cast("int")), F.max(F.col("Total Length of Fwd Packets").cast("int"))).first()
    assert lengths[0] >= 40 and lengths[1] <= 1500
    assert flows.select("Source IP").distinct().count() <= 10
    assert flow_view(flows).where("tenant not like '10.0.0.%'").count() == 0


def test_bursts_are_runs_of_up_to_fifty(spark):
    n = 2550
    flows = synthetic_flows(spark.range(n).withColumnRenamed("id", "i"), n, 0.2, bursty=True, shuffle=False)
    ids = [x["_id"] for x in flows.orderBy("seq").collect()]
    runs = 1 + sum(a != b for a, b in zip(ids, ids[1:]))
    assert 95 <= runs <= 100  # two cells of fifty bursts, where neighbours may agree


def test_full_duplication_is_rejected(spark):
    with pytest.raises(ValueError):
        synthetic_flows(spark.range(10).withColumnRenamed("id", "i"), 10, 1.0)


def test_search_chooses_and_confirms(spark, sf):
    view = event_view(spark, sf)
    trials = search.search_trials(view).cache()
    assert trials.count() == 27
    anchors = {x["duplicate_rate"]: x["dedupe_rate_pct"] for x in trials.where("mode = 'global exact'").collect()}
    assert anchors[0.1] < anchors[0.5] < anchors[1.0]
    none = trials.where("mode = 'no dedupe'")
    assert none.where("valid").count() == 0  # far from the exact rate, hence marked
    assert none.where("notes like '%points away%'").count() == 3
    best = r.best_config(trials.where("mode = 'filter+exact'"), ["error_rate", "capacity"], "score").first()
    assert (best["error_rate"], best["capacity"], best["mean_score"]) == (0.01, 1000, 100.0)  # first of a tie
    final = search.confirm(view, best["error_rate"], best["capacity"], 4)
    rates = {x["algorithm"]: x["dedupe_rate_pct"] for x in final.collect()}
    assert rates["no dedupe"] == 0.0 and rates["filter+exact"] == rates["global exact"]


def test_ranking_sorts_and_drops_the_score(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 2.0)], "name string, score double")
    got = r.ranked(df, "score", "name")
    assert got.columns == ["name"] and [x["name"] for x in got.collect()] == ["a", "c", "b"]
