"""Timed checks of coins and pre-warnings: late rows, restarts and replays."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapelens.streaming import checks, jobs

HOUR, SECOND_MS = 10, 1000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
PRINTS = "token_mint string, ts long, price_usd double, graduated_at long, event_time timestamp"


def prints(rows):
    return [(m, ts, px, g, EPOCH + timedelta(seconds=ts)) for m, ts, px, g in rows]


def expected(rows, until):
    """Checks that are over at `until`, over all rows."""
    out = set()
    for m in {r[0] for r in rows}:
        own = sorted((ts, px) for k, ts, px, g in rows if k == m and ts >= g)
        g = next(r[3] for r in rows if r[0] == m)
        for h in checks.HOURS:
            seen = [x for x in own if x[0] <= g + h * HOUR]
            if seen and g + h * HOUR + 1 <= until:
                out.add((m, h, seen[-1][1], seen[0][1]))
    return out


def run(spark, folder, out):
    stream = spark.readStream.schema(PRINTS).option("maxFilesPerTrigger", 1).parquet(folder)
    df = checks.timed_checks(stream, "5 seconds", HOUR, SECOND_MS, int(EPOCH.timestamp() * 1000))
    jobs.run_available(df, out)
    return sorted(tuple(r) for r in spark.read.schema(checks.CHECKS).parquet(f"{out}/out").drop("final").collect())


def test_checks_equal_batch_over_a_restart_and_late_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"c{k}", g + rng.randrange(-5, 260), rng.choice([1.0, 2.0, rng.random()]), g) for k, g in enumerate((0, 7, 40, 90)) for _ in range(60)]
    rows.sort(key=lambda r: r[1])
    folder, out = str(tmp_path / "in"), str(tmp_path / "run")
    write = lambda part: spark.createDataFrame(prints(part), PRINTS).coalesce(2).write.mode("append").parquet(folder)
    for i in range(0, 120, 40):
        part = rows[i : i + 40]
        rng.shuffle(part)
        write(part)
    run(spark, folder, out)
    for i in range(120, len(rows), 40):
        write(rows[i : i + 40])
    tail = [("z", 1000, 1.0, 900)]
    write(tail)
    first = run(spark, folder, out)
    own = max(r[1] for r in rows + tail if 0 <= r[1] - r[3] <= 24 * HOUR)
    assert set(first) == expected(rows + tail, own - 5) and len(first) == len(set(first)) >= 11
    # a print long behind the watermark changes nothing, also for a coin whose state has expired
    write([("c0", 3, 99.0, 0), ("c3", 95, 99.0, 90)])
    assert run(spark, folder, out) == first


@pytest.mark.parametrize("replays", [1, 2])
def test_one_alert_a_coin_over_replays_and_restarts(spark, tmp_path, replays):
    snapshot = spark.createDataFrame([(m, v) for m, v in zip("abcd", (0.9, 0.1, 0.8, 0.7))], "token_mint string, v double")
    score = lambda rows: rows.withColumn("p", F.col("v")).withColumn("alert", (F.col("v") > 0.5).cast("int")).withColumn("model_version", F.lit(1).cast("long"))
    batches = [[("a", 5), ("a", 3), ("b", 1)], [("a", 2), ("c", 9)], [("c", 1), ("d", 4), ("zz", 1)]]
    for i, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "token_mint string, graduated_at long")
        for _ in range(replays):
            checks.Prewarnings(spark, str(tmp_path / "alerts"), snapshot, score)(batch, i)  # a new object each time, as after a restart
    got = checks.Prewarnings(spark, str(tmp_path / "alerts"), snapshot, score).read().collect()
    assert sorted((r.token_mint, r.alert_ts, r.batch) for r in got) == [("a", 3, 0), ("c", 9, 1), ("d", 4, 2)]
