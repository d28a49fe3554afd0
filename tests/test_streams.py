"""Keyed state that costs what a batch touches, and bounded feeds that give out their end."""

import datetime as dt

from pyspark.sql import functions as F

from granary.sources.tables import exists, new_path
from granary.streaming import jobs
from tests.conftest import rows


def test_a_batch_rewrites_only_its_buckets(spark):
    path = new_path(spark, "state")

    def load(state, batch):
        sums = batch if state is None else state.select("k", "n").unionByName(batch)
        return sums.groupBy("k").agg(F.sum("n").alias("n"))

    state = jobs.KeyedState(spark, path, ["k"], load, buckets=8)
    many = spark.range(200).selectExpr("if(id = 0, null, cast(id as int)) as k", "1L as n")
    state.apply(many, 0)
    assert set(state.manifest(0).values()) == {0} and len(state.manifest(0)) == 8
    one = spark.createDataFrame([(7, 5), (None, 2)], "k int, n long")
    state.apply(one, 1)
    moved = {b for b, v in state.manifest(1).items() if v == 1}
    assert 1 <= len(moved) <= 2
    state.apply(one, 1)  # run again after a failure: the same state
    assert dict(state.latest().select("k", "n").collect()) == {**{i: 1 for i in range(1, 200)}, 7: 6, None: 3}
    state.apply(spark.createDataFrame([(9, 1)], "k int, n long"), 2)
    state.apply(spark.createDataFrame([], "k int, n long"), 3)
    # What no manifest names any more is gone; what the last two name is there.
    assert not any(exists(spark, f"{path}/data/v=0/bucket={b}") for b in moved) and not exists(spark, f"{path}/manifest/v=0")
    assert all(exists(spark, f"{path}/data/v={v}/bucket={b}") for b, v in state.manifest(3).items())
    assert dict(jobs.KeyedState(spark, path, ["k"], load, buckets=8).latest().select("k", "n").collect())[9] == 2


def test_the_end_of_a_bounded_feed_is_given_out(spark):
    at = lambda d, h=0, m=0: dt.datetime(2024, 1, d, h, m)
    schema = "u int, ts timestamp_ntz"
    first = spark.createDataFrame([(1, at(1)), (1, at(1, 0, 20)), (None, at(1, 5))], schema)
    last = spark.createDataFrame([(1, at(9, 23, 50)), (2, at(9, 23, 55)), (1, at(1, 0, 21))], schema)  # the third is late
    sessions = jobs.run_bounded(spark, [first, last], "t", "ts", "2 hours", lambda s: jobs.gap_sessions(s, "ts", "u", "30 minutes", "1 hour"))
    assert rows(sessions) == sorted([(1, at(1), at(1, 0, 50), 2), (None, at(1, 5), at(1, 5, 30), 1), (1, at(9, 23, 50), at(10, 0, 20), 1), (2, at(9, 23, 55), at(10, 0, 25), 1)], key=repr)
    days = jobs.run_bounded(spark, [first, last], "t", "ts", "3 days", lambda s: jobs.daily_partials(s, "ts", ["u"], "1 day"))  # within a day the third row is not late
    assert rows(days) == sorted([(dt.date(2024, 1, 1), 1, 3), (dt.date(2024, 1, 1), None, 1), (dt.date(2024, 1, 9), 1, 1), (dt.date(2024, 1, 9), 2, 1)], key=repr)
    empty = spark.createDataFrame([], schema)
    assert jobs.run_bounded(spark, [empty], "t", "ts", "2 hours", lambda s: jobs.gap_sessions(s, "ts", "u", "30 minutes", "1 hour")).count() == 0
