"""The log of runs and the snapshots: what a reader sees while others write, compact and evict."""

from pyspark.sql import functions as F

from quantlake.sources.versions import RunLog, Snapshots


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, ticker string, n_samples long, oos_sharpe double")


def test_updates_deletions_and_a_second_life(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    assert log.count() == 0 and log.runs().collect() == []
    log.log(runs(spark, ("a", "X", 1, None), ("b", "Y", 2, None)))
    before = log.runs()
    log.update(runs(spark, ("a", "changed", 9, 1.5), ("unknown", "Z", 1, 2.0)))
    state = {r["run_id"]: (r["ticker"], r["n_samples"], r["oos_sharpe"], r["status"]) for r in log.runs().collect()}
    assert state == {"a": ("X", 1, 1.5, "trained"), "b": ("Y", 2, None, "trained")}  # ticker may not be set, unknown stays unknown
    assert log.update(runs(spark, ("a", "no", 1, None)).select("run_id", "ticker")) is None
    log.update(runs(spark, ("a", "X", 1, None)))
    assert log.get("a").first()["oos_sharpe"] is None  # set to null is a change too
    log.compact()
    log.delete(runs(spark, ("a", "X", 1, None)))
    assert [r["run_id"] for r in log.runs().collect()] == ["b"] and log.get("a").count() == 0
    log.log(runs(spark, ("a", "again", 3, None)))
    log.compact()
    log.compact()
    assert {r["run_id"]: r["ticker"] for r in log.runs().collect()} == {"a": "again", "b": "Y"}
    assert log.count("again") == 1 and {r["run_id"] for r in before.collect()} == {"a", "b"}
    log.vacuum()
    assert log.count() == 2 and log.log(runs(spark, ("c", "X", 1, None))) == 6 and log.count() == 3


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    log.log(runs(spark, ("a", "X", 1, None)))
    log.log(runs(spark, ("b", "X", 1, None)))
    success = sorted(tmp_path.glob("changes/*/_SUCCESS"))[-1]
    success.unlink()
    assert [r["run_id"] for r in log.runs().collect()] == ["a"]


def test_a_second_read_scans_the_snapshot(spark, tmp_path):
    now, built = [0.0], []
    cache = Snapshots(spark, str(tmp_path), ttl=10, most=2, clock=lambda: now[0])

    def build(n):
        def f():
            built.append(n)
            return spark.range(n).withColumn("x", F.col("id") * 2)

        return f

    assert cache.get("k", "d1", build(5)).count() == 5
    again = cache.get("k", "d1", build(6))
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert again.count() == 5 and built == [5] and "FileScan parquet" in plan and "Range" not in plan
    old = again
    assert cache.get("k", "d2", build(7)).count() == 7 and old.count() == 5  # a new day; readers of the old one go on
    now[0] = 11.0
    assert cache.get("k", "d2", build(8)).count() == 8  # too old
    assert Snapshots(spark, str(tmp_path), ttl=10, clock=lambda: now[0]).get("k", "d2", build(9)).count() == 8  # another session's
    now[0] = 12.0
    cache.get("l", "d2", build(1))
    now[0] = 13.0
    cache.get("m", "d2", build(1))  # the oldest goes
    assert set(cache.entries()) == {"l", "m"} and cache.stats()["misses"] == 5 and cache.stats()["hits"] == 1
    now[0] = 22.5
    cache.get("n", "d2", build(1))  # l is expired, m is not
    assert set(cache.entries()) == {"m", "n"} and cache.invalidate("m") and not cache.invalidate("m")
    assert len(list(tmp_path.glob("data/*"))) == 6
    cache.vacuum()
    assert len(list(tmp_path.glob("data/*"))) == 1
    cache.clear()
    assert cache.stats()["size"] == 0
