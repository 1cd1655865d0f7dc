"""Numbered lines of split files, broken events by line, snapshots that switch."""

import json
import os

import pytest

from haulgraph.sources import files


def test_broken_events_by_file_and_line(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        bad = {"a.jsonl": {1, 77, 500}, "b.jsonl": {3}, "c.jsonl": set()}
        for name, broken in bad.items():
            n = 0 if name == "c.jsonl" else 500 if name == "a.jsonl" else 40
            lines = ["{\"location\": " if k in broken else "" if k % 50 == 2 else json.dumps({"location": f"{name}:{k}", "runtime_s": k / 2, "details": {"x": "y" * (k % 30)}}) for k in range(1, n + 1)]
            (tmp_path / name).write_text("\n".join(lines) + ("\n" if n == 40 else ""))
        good, wrong = files.checked_events(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert {(os.path.basename(r.file), r.line) for r in wrong.collect()} == {(f, k) for f, held in bad.items() for k in held}
        rows = good.collect()
        assert len(rows) == 540 - 4 - 11 and all(r.location == f"{os.path.basename(r.file)}:{r.line}" for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_failed_snapshot_leaves_the_last_one(spark, tmp_path):
    path = f"{tmp_path}/snap"
    files.snapshot(spark.range(50).toDF("x"), path, "x")
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="no"):
        files.snapshot(spark.range(9).select(F.raise_error(F.lit("no")).cast("long").alias("x")), path)
    assert spark.read.parquet(path).count() == 50
    files.snapshot(spark.range(7).toDF("x"), path)
    assert spark.read.parquet(path).count() == 7 and not [f for f in os.listdir(tmp_path) if ".old-" in f]
