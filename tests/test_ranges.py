"""Scans in ranges, quantile sketches, versioned tables, streams folded exactly once, memos."""

import glob
import json
import os
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphmill.operators import risk, scan, sketch
from graphmill.sources import readers, versions
from graphmill.streaming import telemetry
from tests.conftest import rows

# ---- scans


@pytest.mark.parametrize("keys", [1, 3, 500])
def test_running_values_equal_a_window(spark, keys):
    rng = random.Random(keys)
    data = [(None if k % 7 == 3 else f"k{k}", i, rng.choice([None, 0, 1, 5]), rng.choice([None, None, "a", "b"]), "clash") for i, k in enumerate(rng.randrange(keys) for _ in range(2000))]
    lines = spark.createDataFrame(data, "log string, at int, x int, y string, n string").repartition(5)
    got = scan.running(lines, ["log"], ["at"], {"total": F.col("x")}, {"seen": F.col("y")}, blocks=9)
    w = Window.partitionBy("log").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got) == rows(lines.withColumn("total", F.sum(F.coalesce("x", F.lit(0))).over(w)).withColumn("seen", F.last("y", ignorenulls=True).over(w)))
    if keys == 1:
        assert got.count() == 2000


def test_one_log_in_many_ranges_gives_the_same_commits(spark):
    rng = random.Random(2)
    log, expected, cid, opened = [], [], 0, False
    for i in range(3000):
        kind = rng.choice("hfffb")
        line = f"{rng.getrandbits(160):040x}" if kind == "h" else f" src/f{rng.randrange(50)}.ts " if kind == "f" else "  "
        log.append(("one", i, line))
        if kind in "hb":
            cid, opened = cid + 1, kind == "h"
        elif opened:
            expected.append(("one", cid, line.strip()))
    lines = spark.createDataFrame(log, "log string, line_no long, line string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(readers.commit_segment(lines)) == sorted(expected, key=repr)
        dealt = scan.running(lines, ["log"], ["line_no"], {"cid": F.lit(1)})
        assert rows(dealt.select("line_no", "cid")) == sorted(((i, i + 1) for i in range(3000)), key=repr)
        heads = spark.createDataFrame([("one", i, f"COMMIT|e{i}|n|{i}" if i % 100 == 0 else "" if i % 100 == 99 else f"p{i}") for i in range(1000)], "log string, line_no long, line string")
        got = {(r.cid, r.email, r.path) for r in readers.parse_author_log(heads).collect()}
        assert got == {(i // 100 + 1, f"e{i // 100 * 100}", f"p{i}") for i in range(1000) if i % 100 not in (0, 99)}
        diff = spark.createDataFrame([("d", i, f"diff --git a/x b/f{i}" if i % 50 == 0 else f"@@ -1 +{i},2 @@") for i in range(500)], "diff string, line_no long, line string")
        assert {(r.file, r.start_line, r.end_line) for r in risk.parse_diff(diff).collect()} == {(f"f{i // 50 * 50}", i, i + 1) for i in range(500) if i % 50}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_of_nothing(spark):
    none = spark.createDataFrame([], "log string, line_no long, line string")
    assert readers.commit_segment(none).isEmpty() and readers.parse_author_log(none).isEmpty() and scan.ranked(none, ["line_no"]).isEmpty()


def test_ranks_of_all_rows(spark):
    values = random.Random(1).sample(range(10_000), 700)
    got = scan.ranked(spark.createDataFrame([(v,) for v in values], "v int").repartition(6), ["v"])
    assert {r.v: r["rank"] for r in got.collect()} == {v: i + 1 for i, v in enumerate(sorted(values))}


# ---- quantiles


def sample():
    rng = np.random.default_rng(4)
    parts = {"flat": rng.uniform(0, 1000, 3000), "tail": rng.lognormal(3, 2, 3000), "same": np.full(500, 7.25), "one": np.array([3.5]), "signed": rng.normal(0, 50, 2001), "zero": np.zeros(10)}
    return [(k, float(x)) for k, v in parts.items() for x in np.round(v, 3)]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_sketches_hold_the_quantile_and_its_error(spark, q):
    data = sample()
    frame = spark.createDataFrame([*data, ("flat", None), ("flat", float("nan")), ("none", None)], "tool string, v double").repartition(5)
    state = sketch.histogram(frame, ["tool"], F.col("v"))
    found = {r.tool: r for r in sketch.quantile(state, ["tool"], q).collect()}
    exact = {r.tool: r for r in sketch.exact_quantile(frame, ["tool"], F.col("v"), q).collect()}
    for tool in {k for k, _ in data}:
        own = np.sort([x for k, x in data if k == tool])
        true = own[int((len(own) - 1) * q)]
        r = found[tool]
        assert r.n == len(own) and r.low - 1e-9 <= true <= r.high + 1e-9
        assert abs(r.estimate - true) <= abs(true) * 2**-sketch.BITS + 0.5 / sketch.SCALE + 1e-9
        assert exact[tool].n == len(own) and abs(exact[tool].value - np.quantile(own, q)) < 1e-9 * max(1, abs(true))
    assert "none" not in found and "none" not in exact
    assert state.groupBy("tool").count().agg(F.max("count")).first()[0] <= 2 ** (sketch.BITS - 1) * 64


def test_sketches_merge(spark):
    frame = spark.createDataFrame(sample(), "tool string, v double")
    half = lambda k: frame.where(F.pmod(F.xxhash64("v"), F.lit(2)) == k)
    both = sketch.merged(sketch.histogram(half(0), ["tool"], F.col("v")), sketch.histogram(half(1), ["tool"], F.col("v")))
    assert rows(both.select("tool", "bucket", "n")) == rows(sketch.histogram(frame, ["tool"], F.col("v")).select("tool", "bucket", "n"))


def test_a_stream_s_state_is_the_batch_s_sketch(spark):
    events = telemetry.stream(spark, "/root/testdata/sf0.001", glob="events.parquet")
    q = telemetry.p95_sketch(events).writeStream.format("memory").queryName("sketches").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(300)
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert rows(spark.table("sketches")) == rows(telemetry.p95_sketch(batch))
    exact = {r.event_type: r.p95 for r in telemetry.p95_by_tool(batch).collect()}
    for r in telemetry.p95_estimates(spark.table("sketches")).collect():
        assert abs(r.estimate - exact[r.event_type]) <= 0.05 * exact[r.event_type]


# ---- versions


def table_of(spark, n):
    return spark.range(n).withColumn("v", F.lit(n))


def test_a_reader_keeps_its_version_whole(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert versions.current(spark, root) is None and versions.expire(spark, root) == 0
    versions.publish({"a": table_of(spark, 5), "b": table_of(spark, 6)}, root, {"head": "h1", "files": 2, "tier": 1})
    old = versions.current(spark, root)
    reading = old.read(spark, "a")
    versions.publish({"a": table_of(spark, 50), "b": table_of(spark, 60)}, root, {"head": "h2", "files": 2, "tier": 2})
    assert reading.count() == 5 and old.read(spark, "b").count() == 6
    assert versions.current(spark, root).read(spark, "a").count() == 50
    # a writer that died left half a pointer, and a folder that none names
    with open(tmp_path / "store" / "pointers" / f"{3:020d}.json", "w") as f:
        f.write('{"stamp": {"he')
    versions.write(table_of(spark, 1), root, "a")
    assert versions.current(spark, root).number == 2
    assert versions.publish({"a": table_of(spark, 7)}, root, {"head": "h3", "files": 2, "tier": 0}).number == 3
    assert versions.expire(spark, root, keep=1, older_than=3600) == 0
    assert versions.expire(spark, root, keep=1, older_than=-60) == 5
    assert versions.current(spark, root).read(spark, "a").count() == 7 and len(os.listdir(tmp_path / "store" / "data")) - 1 <= 1


def test_versions_match_head_files_and_tier(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    made = []

    def compute(n):
        made.append(n)
        return {"a": table_of(spark, n)}

    first, renew = versions.serve(spark, root, "h1", 10, 2, lambda: compute(1))
    assert renew is None and made == [1]
    assert versions.serve(spark, root, "h1", 10, 1, lambda: compute(2))[1] is None and made == [1]  # a lower tier is in it
    for head, files in (("h2", 10), ("h1", 11)):
        stale, renew = versions.serve(spark, root, head, files, 2, lambda: compute(3))
        assert stale == first and renew is not None
    higher, renew = versions.serve(spark, root, "h1", 10, 4, lambda: compute(4))  # none of that tier yet
    assert renew is None and made == [1, 4] and higher.read(spark, "a").count() == 4
    old, renew = versions.serve(spark, root, "h1", 10, 2, lambda: compute(5), max_age=-1)
    assert old == higher and renew().read(spark, "a").count() == 5
    assert versions.matching(spark, root, "h1", 10, 2).number == 3 and versions.matching(spark, root, "h9", 10) is None


def test_of_writers_at_once_each_gets_a_number(spark, tmp_path):
    root = f"file://{tmp_path}/race"
    made = []
    threads = [threading.Thread(target=lambda i=i: made.append(versions.point(spark, root, {"epoch": i}, {"a": []}))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert sorted(v.number for v in made) == list(range(1, 7))
    assert versions.point(spark, root, {}, {}, after=3) is None and versions.point(spark, root, {}, {}, after=6).number == 7


# ---- exactly once


def test_epochs_that_are_replayed_count_once(spark, tmp_path):
    root = f"file://{tmp_path}/fold"
    batch = lambda lo: spark.range(lo, lo + 100).select((F.col("id") % 7).alias("user_id"), F.timestamp_seconds("id").alias("ts"))
    combine = lambda b: telemetry.merged_churn(telemetry.churn_of(b) if "commits" not in b.columns else b)
    for epoch in range(7):
        for _ in range(2):
            done = versions.fold(batch(100 * epoch), root, "churn", combine, epoch, most_parts=3)
        assert not done
        assert len(versions.current(spark, root).tables["churn"]) <= 3
    whole = spark.range(700).select((F.col("id") % 7).alias("user_id"), F.timestamp_seconds("id").alias("ts"))
    assert rows(versions.folded(spark, root, "churn", telemetry.merged_churn)) == rows(telemetry.churn_of(whole))


def test_a_stream_is_stopped_replayed_and_equals_its_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    inbox, store, offsets = (f"file://{tmp_path}/{x}" for x in ("inbox", "store", "offsets"))
    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).repartition(3).write.mode("append").parquet(inbox)
        telemetry.fold_churn(telemetry.stream(spark, inbox, files=2), store, offsets)
        # the last batch is forgotten, as if the driver had died after its table was written
        last = max(glob.glob(f"{tmp_path}/offsets/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))
        os.remove(last)
        for crc in glob.glob(f"{tmp_path}/offsets/commits/.*.crc"):
            os.remove(crc)
    telemetry.fold_churn(telemetry.stream(spark, inbox, files=2), store, offsets)
    assert json.loads(open(max(glob.glob(f"{tmp_path}/store/pointers/0*.json"))).read())["stamp"]["epoch"] >= 4
    assert rows(versions.folded(spark, store, "churn", telemetry.merged_churn)) == rows(telemetry.churn_of(events))


# ---- memos


def test_only_unseen_keys_are_computed(spark, tmp_path):
    root = f"file://{tmp_path}/memo"
    asked = spark.sparkContext.accumulator(0)

    def compute(unseen):
        def count(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b

        return unseen.mapInArrow(count, unseen.schema).select("hash", F.length("content").alias("size"))

    files = lambda texts: spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, content string").withColumn("hash", F.sha2("content", 256))
    first = ["a", "bb", "bb", "ccc", None]
    out, n = versions.memoized(files(first), root, "hash", compute)
    assert n == 3 and asked.value == 3
    assert {r.path: r["size"] for r in out.collect()} == {f"p{i}": None if t is None else len(t) for i, t in enumerate(first)}
    out, n = versions.memoized(files(first), root, "hash", compute)
    assert n == 0 and asked.value == 3 and out.count() == 5
    out, n = versions.memoized(files([*first, "dddd"]), root, "hash", compute)
    assert n == 1 and asked.value == 4 and {r.path: r["size"] for r in out.collect()}["p5"] == 4
    for k in range(9):
        versions.memoized(files([f"{k:05d}"]), root, "hash", compute, most_parts=3)
    assert len(versions.current(spark, root).tables["memo"]) <= 3 and asked.value == 13
    assert versions.memoized(files(first), root, "hash", compute)[1] == 0
    assert time.time() - versions.current(spark, root).made < 600
