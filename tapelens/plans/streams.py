"""Streaming jobs run over everything available, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens.plans.memory import smart
from tapelens.plans.registry import cte, query
from tapelens.sources.tables import HOUR_S
from tapelens.streaming import checks, jobs


def swaps_stream(t):
    return jobs.event_swaps(jobs.file_stream(t.spark, t.folder, "events"))


@query("stream_rolling_narratives", "e", """SELECT label, start, count(*) AS velocity, CASE WHEN count(*) >= 50 THEN 'hot' WHEN count(*) >= 5 THEN 'emerging' ELSE 'fading' END AS status FROM (
SELECT event_type AS label, ts, unnest(generate_series(0, 11)) AS i, time_bucket(INTERVAL '5 minutes', ts) - i * INTERVAL '5 minutes' AS start FROM events) WHERE start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2""")
def _(t):
    m = jobs.file_stream(t.spark, t.folder, "events").select(F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("event_time"))
    folder = jobs.run_folder(t.spark, "narratives")
    jobs.run_available(jobs.rolling_narratives(m), folder)
    out = t.spark.read.schema("label string, start timestamp, velocity long").parquet(f"{folder}/out")
    return jobs.narrative_states(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_first_anchor", "e", "SELECT token_mint, min(ts) + 500 AS graduated_at, count(*) AS reports FROM t_swaps GROUP BY 1")
def _(t):
    s = swaps_stream(t).select("token_mint", (F.col("ts") + 500).alias("graduated_at"), "event_time")
    folder = jobs.run_folder(t.spark, "anchors")
    table = jobs.BatchTable(t.spark, f"{folder}/table", jobs.ANCHORS, jobs.anchor_partials)
    jobs.run_available(s, folder, table)
    return jobs.first_anchors(table.read())


_ck = ", ".join(f"({c})" for c in jobs.CHECKPOINTS)


@query("stream_checkpoint_features", "e", f"""SELECT token_mint, checkpoint_s, count(*) AS n_trades, count(*) FILTER (side = 'buy') AS n_buys,
  round(CAST(sum(CAST(CASE WHEN side = 'buy' THEN sol_amount ELSE -sol_amount END AS DECIMAL(18,6))) AS DOUBLE), 6) AS net_sol, max(sol_amount) AS max_sol
FROM t_post CROSS JOIN (VALUES {_ck}) c(checkpoint_s) WHERE ts - graduated_at < checkpoint_s GROUP BY 1, 2""")
def _(t):
    folder = jobs.run_folder(t.spark, "checkpoints")
    table = jobs.BatchTable(t.spark, f"{folder}/table", jobs.FEATURES, jobs.checkpoint_partials)
    jobs.run_available(swaps_stream(t).join(t.coins.select("token_mint", "graduated_at"), "token_mint"), folder, table)
    return jobs.checkpoint_features(table.read()).withColumn("net_sol", F.round("net_sol", 6))


@query("stream_tagged_flow", "e", """SELECT tag, count(*) AS n FROM (SELECT CASE WHEN m.wallet IS NOT NULL THEN 'team' ELSE 'unknown' END AS tag FROM t_swaps s LEFT JOIN t_team m ON m.token_mint = s.token_mint AND m.wallet = s.signer) GROUP BY 1""")
def _(t):
    folder = jobs.run_folder(t.spark, "flow")
    table = jobs.BatchTable(t.spark, f"{folder}/table", "tx_signature string, tag string")
    jobs.run_available(jobs.tagged_flow(swaps_stream(t), t.team).select("tx_signature", "tag"), folder, table)
    return table.read().dropDuplicates(["tx_signature"]).groupBy("tag").agg(F.count("*").alias("n"))


@query("stream_first_exit_alert", "e", "SELECT token_mint, min(ts) AS alert_ts FROM t_team_sells GROUP BY 1")
def _(t):
    folder = jobs.run_folder(t.spark, "exits")
    earliest = lambda rows: rows.groupBy("token_mint").agg(F.min("alert_ts").alias("alert_ts"))
    table = jobs.BatchTable(t.spark, f"{folder}/table", "token_mint string, alert_ts long", earliest)
    jobs.run_available(jobs.first_exit_alerts(swaps_stream(t), t.team, t.coins.select("token_mint", "graduated_at")), folder, table)
    return earliest(table.read())


@query("stream_watched_buys", "e", "SELECT s.signer, count(*) AS n FROM t_swaps s JOIN t_smart_list w ON w.wallet = s.signer WHERE side = 'buy' GROUP BY 1")
def _(t):
    from tapelens.plans.memory import SMART_SCORE

    folder = jobs.run_folder(t.spark, "watched")
    s = jobs.watched_buys(swaps_stream(t), smart(t).filter(F.col("score") >= SMART_SCORE)).select("signer", "tx_signature")
    jobs.run_available(s, folder)
    return t.spark.read.schema("signer string, tx_signature string").parquet(f"{folder}/out").groupBy("signer").agg(F.count("*").alias("n"))


@query("stream_launch_window", "e", """SELECT token_mint, count(*) AS n_buyers FROM (SELECT DISTINCT b.token_mint, b.signer FROM (SELECT json_extract_string(props, '$.k') AS token_mint, CAST(user_id AS VARCHAR) AS signer, ts FROM events WHERE event_type IN ('purchase', 'signup')) b
JOIN (SELECT json_extract_string(props, '$.k') AS token_mint, min(ts) AS c FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1) k ON k.token_mint = b.token_mint AND b.ts BETWEEN c AND c + INTERVAL '5 days') GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    """Creates arrive as a stream of their own; the window is days long because the landed log is sparse."""
    folder = jobs.run_folder(t.spark, "launch")
    first = t.raw("events").filter(F.col("event_type").isin("error", "purchase", "signup")).groupBy(F.get_json_object("props", "$.k").alias("token_mint")).agg(F.min("ts").cast("timestamp").alias("event_time"))
    first.write.parquet(f"{folder}/creates")
    creates = t.spark.readStream.schema(first.schema).parquet(f"{folder}/creates")
    jobs.run_available(jobs.launch_buys(creates, swaps_stream(t).filter("side = 'buy'"), "5 days"), folder)
    landed = t.spark.read.schema("token_mint string, signer string, created_time timestamp").parquet(f"{folder}/out")
    return jobs.launch_windows(landed).select("token_mint", "n_buyers")


@query("stream_feed_watchdog", "e", """SELECT feed, count(*) AS episodes, CAST(sum(events) AS BIGINT) AS events FROM (
SELECT feed, sid, count(*) AS events, max(ts) + INTERVAL '30 minutes' AS stalled_at FROM (
  SELECT feed, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
  FROM (SELECT event_type AS feed, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS prev FROM events)) GROUP BY 1, 2)
WHERE stalled_at <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1""")
def _(t):
    folder = jobs.run_folder(t.spark, "watchdog")
    hb = jobs.file_stream(t.spark, t.folder, "events").select(F.col("event_type").alias("feed"), F.col("ts").cast("timestamp").alias("event_time"))
    jobs.run_available(jobs.feed_watchdog(hb), folder)
    return t.spark.read.schema("feed string, start timestamp, stalled_at timestamp, events long").parquet(f"{folder}/out").groupBy("feed").agg(
        F.count("*").alias("episodes"), F.sum("events").alias("events"))


# ── timed checks ─────────────────────────────────────────────────────────────
SECOND_MS, EPOCH_MS, CHECK_DELAY = 600_000, 1_704_067_200_000, "10 minutes"
cte("t_due", f"""SELECT token_mint, h AS check_offset_h FROM t_coins CROSS JOIN (VALUES (1), (4), (24)) v(h)
WHERE {EPOCH_MS} + (graduated_at + h * {HOUR_S} + 1) * {SECOND_MS} <= (SELECT epoch_ms(max(ts)) FROM events JOIN t_coins k ON k.token_mint = json_extract_string(props, '$.k')
  WHERE event_type IN ('error', 'purchase', 'signup') AND (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 600000000 - graduated_at BETWEEN 0 AND {24 * HOUR_S}) - 600000""")


def landed_checks(t):
    """Checks of the event stream; every run lands in its own folder."""
    prints = swaps_stream(t).withColumn("price_usd", F.col("sol_amount") / F.col("token_amount")).join(t.coins.select("token_mint", "graduated_at"), "token_mint")
    folder = jobs.run_folder(t.spark, "checks")
    jobs.run_available(checks.timed_checks(prints, CHECK_DELAY, HOUR_S, SECOND_MS, EPOCH_MS), folder)
    return t.spark.read.schema(checks.CHECKS).parquet(f"{folder}/out")


@query("stream_timed_checks", "e", "SELECT o.token_mint, o.check_offset_h, o.price, o.launch_price, o.price_change_pct, o.classified FROM t_outcomes o JOIN t_due USING (token_mint, check_offset_h)")
def _(t):
    return checks.labelled(landed_checks(t))


@query("stream_final_trajectory", "e", "SELECT x.* FROM t_traj x JOIN t_due d ON d.token_mint = x.token_mint AND d.check_offset_h = 24")
def _(t):
    return checks.finalised(landed_checks(t), t.post, t.team)
