"""Post-anchor behaviour by check against a plain count."""

import random

from tapelens.operators import memory


def test_behavior_matches_plain_count(spark, tape):
    rng, hours, hour_s = random.Random(3), [1, 4, 24], 10
    rows = [(rng.randrange(-20, 260), rng.choice(["buy", "buy", "sell"]), f"w{rng.randrange(40)}", 1, 1) for _ in range(300)]
    was = {}
    for ts, side, w, *_ in rows:
        if ts < 0:
            was[w] = was.get(w, 0) + (1 if side == "buy" else -1)
    was = {w: v for w, v in was.items() if v > 0} | {"gone": 2}  # a holder without any trade on the tape
    team = [w for i, w in enumerate(sorted(was)) if i % 2 == 0]
    frame = lambda data, names: spark.createDataFrame(data, names)
    total = float(sum(was.values()))
    out = memory.post_grad_behavior(
        tape(rows), frame([("m", w) for w in team], "token_mint string, wallet string"), frame([("m", w, float(v)) for w, v in was.items()], "token_mint string, wallet string, amount double"),
        frame([("m", total)], "token_mint string, total_supply double"), hours, hour_s)
    assert all("wallet-checks" in f for f in out.inputFiles()) and out.inputFiles()  # trades are read once, into the stored table
    got = {r.check_offset_h: r for r in out.collect()}
    for h in hours:
        bal = {}
        for ts, side, w, *_ in rows:
            if ts <= h * hour_s:
                bal[w] = bal.get(w, 0) + (1 if side == "buy" else -1)
        bal = {w: v for w, v in bal.items() if v > 0}
        r = got[h]
        assert (r.holder_count, r.new_holders, r.churned_holders) == (len(bal), len(set(bal) - set(was)), len(set(was) - set(bal)))
        assert abs(r.top10_pct - sum(sorted(bal.values())[-10:]) / total * 100) < 0.006
        assert abs(r.team_sold_pct - sum(was.get(w, 0) - bal.get(w, 0) for w in team) / total * 100) < 0.006
