"""Scans and sinks round-trip through a scratch folder."""

import glob
import re
import tempfile
import time

from pyspark.sql import functions as F

from fathom.sources import readers, sinks
from fathom.sources.materialize import materialize


def test_csv_pair_and_series_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="fathom-src-")
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, "x")], "id string, v double, s string")
    sinks.save_csv(df.filter("id = 'a'"), f"{root}/train.csv")
    sinks.save_csv(df.filter("id = 'b'"), f"{root}/test.csv")
    tr, te = readers.read_tabular_pair(spark, root, key="id", schema="id string, v double, s string")
    both = readers.with_split(tr, te)
    got = {(r.id, r.v, r.s, r.split) for r in both.collect()}
    assert got == {("a", 1.0, None, "train"), ("b", None, "x", "test")}
    # hive-partitioned series: one folder per id, only part-0.parquet files count
    ser = spark.createDataFrame([("7", 0, 0.5), ("7", 1, 0.7), ("12", 0, 1.0)], "id string, step int, enmo double")
    ser.write.partitionBy("id").parquet(f"{root}/series")
    s = readers.read_series(spark, f"{root}/series", file_name=None, drop=("step",))
    assert dict(s.groupBy("id").count().collect()) == {"7": 2, "12": 1}
    assert s.schema["id"].dataType.typeName() == "string"


def test_feature_list_and_materialize(spark):
    root = tempfile.mkdtemp(prefix="fathom-mat-")
    sinks.save_feature_list(spark, ["b", "a", "c"], f"{root}/features")
    assert sinks.read_feature_list(spark, f"{root}/features") == ["b", "a", "c"]
    src = spark.range(100).withColumn("x", F.col("id") % 7)
    calls = []

    def compute():
        calls.append(1)
        return src.groupBy("x").count()

    a = materialize(spark, f"{root}/m", {"op": "count"}, src, compute)
    b = materialize(spark, f"{root}/m", {"op": "count"}, src, compute)
    assert len(calls) == 1 and a.count() == b.count() == 7
    materialize(spark, f"{root}/m", {"op": "count"}, src.filter("id > 3"), compute)   # content changed
    assert len(calls) == 2


def test_series_of_many_keys_are_written_and_listed_by_a_few_tasks_per_core(spark):
    root, sc = tempfile.mkdtemp(prefix="fathom-series-") + "/s", spark.sparkContext
    tasks, keys = 4 * sc.defaultParallelism, 4 * sc.defaultParallelism + 40
    rows = [(i % keys, i, i / 2) for i in range(3 * keys)] + [(None, -1, 0.5), (None, -2, None)]
    sinks.save_series(spark.createDataFrame(rows, "id long, step long, x double"), root)
    files = glob.glob(f"{root}/id=*/part-*.parquet")
    assert len(files) == keys + 1 and len({f.rsplit("/", 1)[0] for f in files}) == keys + 1
    writers = {re.search(r"part-(\d+)", f).group(1) for f in files}
    assert len(writers) > sc.defaultParallelism                        # was one task: few bytes, many files
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    sc.setJobGroup("series-listing", "listing of the series folders")
    try:
        s = readers.read_series(spark, root, file_name="part-*.parquet")
        tracker, until = sc.statusTracker(), time.time() + 20
        while not (jobs := tracker.getJobIdsForGroup("series-listing")) and time.time() < until:
            time.sleep(0.1)
        stages = [tracker.getStageInfo(i) for j in jobs for i in tracker.getJobInfo(j).stageIds]
        assert jobs and max(x.numTasks for x in stages if x) <= tasks  # was a task per key
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(listing) == before and s.schema["id"].dataType.typeName() == "string"
    assert sorted((r.id or "", r.step, r.x) for r in s.collect() if r.x is not None) == sorted(
        ("" if k is None else str(k), i, x) for k, i, x in rows if x is not None)
    assert s.where("id IS NULL").count() == 2
