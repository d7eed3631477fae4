"""Steps that all samples share read no more rows than their result needs."""

import datetime

from tapelens.operators import memory
from tapelens.sources.tables import Tables


def test_all_trades_come_from_the_stored_tape(spark, tmp_path):
    day = datetime.datetime(1996, 1, 1)
    items = [(o, p, 1, 2.0, 10.0, "N", day) for o, p in ((1, 7), (1, None), (2, 8), (9, 8))]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5), (2, 6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    assert sorted((r.wallet, r.ts) for r in t.all_trades.collect()) == [("5", 365), ("5", 365), ("6", 365)]
    assert "price_usd" not in t.phase_rows.columns and {r.price_usd for r in t.phased.collect()} == {0.005}


def test_smart_score_leaves_out_trades_after_the_last_question(spark):
    asking = spark.createDataFrame([("m", "a", 500)], "token_mint string, wallet string, graduated_at long")
    calls = spark.createDataFrame([("a", 10, "moon")], "wallet string, graduated_at long, classified string")
    buys = spark.createDataFrame([("a", 480)], "wallet string, ts long")
    trades = spark.createDataFrame([("a", 5, 100), ("a", 500, 100), ("a", 501, 900), ("b", 1, 7)], "wallet string, ts long, n long")
    df = memory.smart_scores_as_of(asking, calls, buys, trades, 100, 30)
    raw = 0.60 + 0.25 * 200 / 500 + 0.15 * (1 - (20 / 30) / 90)
    assert [tuple(r) for r in df.collect()] == [("m", "a", round(raw, 4))]
    assert "last_ask" in df._jdf.queryExecution().optimizedPlan().toString()
