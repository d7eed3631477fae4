"""Micro-batches, late rows and a restart give the batch result."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapelens.streaming import jobs

SWAP = "token_mint string, signer string, side string, sol_amount double, ts long, event_time timestamp, graduated_at long"


def trades(n, start):
    return [(f"m{i % 3}", f"w{i % 7}", "buy" if i % 4 else "sell", 1.0 + i % 5, start + i * 13 % 900, datetime(2024, 1, 1) + timedelta(seconds=start + i), 40) for i in range(n)]


@pytest.fixture
def landed(spark, tmp_path):
    """Three files that arrive one after another; the last one holds earlier trades (late rows)."""
    data = [trades(60, 300), trades(50, 900), trades(40, 50)]

    def add(k):
        spark.createDataFrame(data[k], SWAP).coalesce(1).write.mode("append").parquet(f"{tmp_path}/swaps.parquet")

    return add, [r for d in data for r in d], str(tmp_path)


def run(spark, folder, out):
    """A new job object each time, as after a restart; offsets and partials are in the folder."""
    table = jobs.BatchTable(spark, f"{out}/table", jobs.FEATURES, jobs.checkpoint_partials)
    anchors = jobs.BatchTable(spark, f"{out}/anchors", jobs.ANCHORS, lambda b: jobs.anchor_partials(b.withColumn("graduated_at", F.col("ts"))))
    jobs.run_available(jobs.file_stream(spark, folder, "swaps", 1), f"{out}/f", table)
    jobs.run_available(jobs.file_stream(spark, folder, "swaps", 1), f"{out}/a", anchors)
    return table, anchors


def test_restart_and_late_rows(spark, landed, tmp_path):
    add, rows, folder = landed
    out = str(tmp_path / "out")
    assert jobs.BatchTable(spark, f"{out}/table", jobs.FEATURES).read().count() == 0
    add(0)
    add(1)
    run(spark, folder, out)
    add(2)
    table, anchors = run(spark, folder, out)
    assert len({r.batch for r in spark.read.parquet(f"{out}/table").select("batch").distinct().collect()}) == 3
    want = jobs.checkpoint_features(jobs.checkpoint_partials(spark.createDataFrame(rows, SWAP)))
    assert sorted(map(tuple, jobs.checkpoint_features(table.read()).collect())) == sorted(map(tuple, want.collect()))
    first = {r.token_mint: (r.graduated_at, r.reports) for r in jobs.first_anchors(anchors.read()).collect()}
    assert first == {m: (min(r[4] for r in rows if r[0] == m), sum(r[0] == m for r in rows)) for m in ("m0", "m1", "m2")}
    # a replayed batch overwrites its own partition
    table(spark.createDataFrame(rows[:60], SWAP), 0)
    assert sorted(map(tuple, jobs.checkpoint_features(table.read()).collect())) == sorted(map(tuple, want.collect()))


def test_narrative_peak(spark):
    rows = [("a", datetime(2024, 1, 1, h), v) for h, v in enumerate([3, 60, 8, 2])]
    got = [r.status for r in jobs.narrative_states(spark.createDataFrame(rows, "label string, start timestamp, velocity long")).orderBy("start").collect()]
    assert got == ["fading", "hot", "emerging", "fading"]
