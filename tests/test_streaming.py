import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crosscut.plans import derived
from crosscut.sources.scans import read_events
from crosscut.streaming import keyed, sinks, state

DIR = "/root/testdata/sf0.001/events.parquet"


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark):
    import os
    import shutil
    import tempfile

    d = tempfile.mkdtemp()
    shutil.copy(DIR, os.path.join(d, "events.parquet"))
    return derived.hook_events(read_events(spark, d, stream=True))


def test_usage_stream_equals_table(spark):
    table = derived.hook_events(read_events(spark, DIR))
    want = sorted(map(tuple, state.monthly_usage(table, 20_000).collect()))
    got = sorted(map(tuple, run(state.monthly_usage(state.with_watermark(stream(spark)), 20_000), "complete", "usage").collect()))
    assert got == want and want


def test_plans_stream_equals_table(spark):
    table = derived.hook_events(read_events(spark, DIR))
    want = sorted(map(tuple, state.latest_plans(table).collect()))
    assert sorted(map(tuple, run(state.latest_plans(stream(spark)), "complete", "plans").collect())) == want


def test_windows_that_begin_with_the_first_request(spark):
    table = run(state.first_hit_windows(stream(spark), seconds=3600), "append", "hits").collect()
    rows = sorted((r["installation_id"], r["ts"]) for r in derived.hook_events(read_events(spark, DIR)).collect())
    want, start, n, who = [], None, 0, None
    for k, ts in rows:
        if k != who:
            who, start, n = k, ts, 0
        elif (ts - start).total_seconds() >= 3600:
            want.append((k, start, n))
            start, n = ts, 0
        n += 1
    assert sorted((r["installation_id"], r["start"], r["requests"]) for r in table) == want


def test_routes(spark):
    df = spark.createDataFrame([("pull_request", "opened", 1), ("pull_request", "closed", 1), ("pull_request", "opened", None), ("installation", "created", 1), ("odd", "x", 1)], "event string, action string, installation_id long")
    assert [r["route"] for r in state.route(df).collect()] == ["analyze", None, None, "baseline", None]


HOOKS = "event_id long, ts timestamp, installation_id long, event string, action string, tokens long, purchase string, plan_name string"


class Feed:
    """A folder that a stream reads file by file, with the stream's checkpoint and outputs beside it."""

    def __init__(self, spark):
        self.spark, self.root, self.n = spark, tempfile.mkdtemp(prefix="feed-"), 0

    def path(self, name):
        return f"file://{self.root}/{name}"

    def add(self, rows):
        self.n += 1
        at = f"{self.root}/in/{self.n:04}.parquet"
        os.makedirs(f"{self.root}/in", exist_ok=True)
        names = [c.split()[0] for c in HOOKS.split(", ")]
        kinds = {"long": pa.int64(), "timestamp": pa.timestamp("us", tz="UTC"), "string": pa.string()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in HOOKS.split(", ")])
        pq.write_table(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema), at)

    def read(self):
        return self.spark.readStream.schema(HOOKS).option("maxFilesPerTrigger", 1).parquet(self.path("in"))

    def run(self, writer, **trigger):
        q = writer.option("checkpointLocation", self.path("checkpoint")).trigger(**(trigger or {"availableNow": True})).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()

    def out(self, name="out"):
        return self.spark.read.parquet(self.path(name))


def at(seconds, month=1):
    return dt.datetime(2026, month, 1) + dt.timedelta(seconds=seconds)


def hook(k, ts, who=1, tokens=10, event="pull_request", action="opened", purchase=None, plan=None):
    return (k, ts, who, event, action, tokens, purchase, plan)


@pytest.fixture
def rocks(spark):
    for k, v in keyed.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in keyed.STORE:
        spark.conf.unset(k)


def test_quota_rejects_within_the_stream_over_restarts(rocks):
    feed, sent = Feed(rocks), []
    for part in range(3):
        rows = [hook(part * 100 + k, at(part * 50 + k), who=k % 3, tokens=k % 7) for k in range(40)] + [hook(part * 100 + 90, at(part, month=2), who=1, tokens=None)]
        feed.add(rows)
        sent += rows
        feed.run(keyed.quota_gate(feed.read(), limit=60).writeStream.format("parquet").option("path", feed.path("out")), once=True)  # time goes on, so it never runs out of batches
    used, want = {}, {}
    for k, ts, who, _, _, tokens, *_ in sorted(sent, key=lambda r: (r[1], r[0])):
        u = used.get((who, ts.month), 0)
        want[k] = (u, u < 60)
        used[who, ts.month] = u + ((tokens or 0) if u < 60 else 0)
    got = {r["event_id"]: (r["used"], r["allowed"]) for r in feed.out().collect()}
    assert got == want and {a for _, a in got.values()} == {True, False}


def test_windows_are_closed_by_timers_over_restarts(rocks):
    feed = Feed(rocks)
    run = lambda: feed.run(keyed.hit_windows(feed.read(), limit=2, seconds=60).writeStream.format("parquet").option("path", feed.path("out")))
    feed.add([hook(1, at(0)), hook(2, at(10)), hook(3, at(59)), hook(4, at(5), who=2)])
    run()
    feed.add([hook(5, at(61)), hook(6, at(130))])
    run()
    feed.add([hook(7, at(500), who=3)])
    run()
    feed.add([hook(8, at(2000), who=4)])
    run()
    got = sorted((r["caller"], r["start"], r["requests"], r["rejected"]) for r in feed.out().collect())
    assert got == [(1, at(0), 3, 1), (1, at(61), 1, 0), (1, at(130), 1, 0), (2, at(5), 1, 0), (3, at(500), 1, 0)]


def test_a_batch_that_comes_again_changes_no_plan(spark):
    feed = Feed(spark)
    buy = lambda k, who, purchase, plan="Starter": hook(k, at(k), who, event="marketplace_purchase", purchase=purchase, plan=plan)
    batches = [[buy(1, 1, "purchased"), buy(2, 2, "purchased", "Team"), buy(3, 3, "pending_change")], [buy(5, 2, "cancelled"), buy(6, 4, "purchased", "x")], [buy(4, 2, "changed", "Team"), buy(7, 1, "changed", "Enterprise")]]
    merge, seen = sinks.merge_plans(feed.path("plans")), []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, HOOKS)
        for _ in range(2):
            merge(df, k)
            seen.append(sorted(map(tuple, sinks.current_plans(spark, feed.path("plans")).collect())))
    assert seen[0] == seen[1] == [(1, "pro"), (2, "enterprise")] and seen[2] == seen[3] == [(1, "pro"), (4, "free")]
    assert seen[4] == seen[5] == [(1, "enterprise"), (4, "free")] and sinks.versions(spark, feed.path("plans")) == [1, 2]


def test_plans_of_a_stream_equal_the_table(spark):
    feed, events = Feed(spark), derived.hook_events(read_events(spark, DIR))
    feed.read_all = derived.hook_events(read_events(spark, stream_folder(), stream=True))
    feed.run(feed.read_all.writeStream.foreachBatch(sinks.merge_plans(feed.path("plans"))))
    assert sorted(map(tuple, sinks.current_plans(spark, feed.path("plans")).collect())) == sorted(map(tuple, state.latest_plans(events).collect()))


def stream_folder():
    import shutil

    d = tempfile.mkdtemp()
    shutil.copy(DIR, os.path.join(d, "events.parquet"))
    return d


def test_a_failure_between_two_sinks_loses_and_doubles_nothing(spark):
    feed = Feed(spark)
    feed.add([hook(1, at(1)), hook(2, at(2), event="installation"), hook(3, at(3), event="odd"), hook(1, at(1))])
    feed.add([hook(4, at(4)), hook(5, at(5), event="check_suite"), hook(6, at(6), who=None, event="installation")])
    to = {"analyze": feed.path("analyze"), "baseline": feed.path("baseline"), "log": feed.path("log")}
    valid = F.col("installation_id").isNotNull()

    class Broken(dict):
        def items(self):
            for k, v in super().items():
                yield k, v
                raise RuntimeError("lost between two sinks")

    for s in (Broken(to), to, to):
        writer = feed.read().writeStream.foreachBatch(sinks.deliver(s, state.route, feed.path("failed"), valid, name="event_id"))
        if isinstance(s, Broken):
            with pytest.raises(Exception, match="lost between"):
                feed.run(writer)
        else:
            feed.run(writer)
    ids = {n: sorted(r["event_id"] for r in feed.out(n).collect()) for n in ("analyze", "baseline", "log", "failed")}
    assert ids == {"analyze": [1, 4], "baseline": [2], "log": [5], "failed": [3, 6]}
