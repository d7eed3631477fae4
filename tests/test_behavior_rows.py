"""The behavior step stores no row that no check counts."""

from tapelens.operators import memory


def test_trades_after_the_last_check_are_not_stored(spark, tape, monkeypatch):
    rows = tape([(-5, "buy", "a", 1, 1), (5, "buy", "b", 1, 1), (15, "sell", "a", 1, 1), (50, "buy", "late", 1, 1)])
    was = spark.createDataFrame([("m", "a", 1.0)], "token_mint string, wallet string, amount double")
    kept = []
    monkeypatch.setattr(memory, "stored", lambda df, name: kept.append(sorted(r.wallet for r in df.collect())) or df)
    out = memory.post_grad_behavior(rows, was, was, was.select("token_mint", (was.amount * 10).alias("total_supply")), [4, 1], 10)
    got = sorted(tuple(r) for r in out.collect())
    assert kept == [["a", "b"]]
    assert got == [("m", 1, 2, 20.0, 1, 0, 0.0, "DUMPED"), ("m", 4, 1, 10.0, 1, 1, 10.0, "DUMPED")]
