"""Links, components and entities against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from tapelens.operators import entities, links
from tapelens.operators.components import connected_components


def union_find(pairs):
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def test_components_chain_hub_and_random(spark):
    rng = random.Random(4)
    graphs = {"chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)], "hub": [("a", f"x{i:03d}") for i in range(200)],
              "rand": [(f"r{rng.randrange(80):02d}", f"r{rng.randrange(80):02d}") for _ in range(60)]}
    df = spark.createDataFrame([(g, a, b) for g, es in graphs.items() for a, b in es if a != b], "g string, a string, b string")
    got = {(r.g, r.node): r.comp for r in connected_components(df, ["g"]).collect()}
    assert got == {(g, n): c for g, es in graphs.items() for n, c in union_find([e for e in es if e[0] != e[1]]).items()}


def random_tape(tape, n=80, seconds=60, wallets=25, seed=6):
    rng = random.Random(seed)
    return [(rng.randrange(seconds), rng.choice(["buy", "sell"]), f"w{rng.randrange(wallets):02d}", rng.choice([1, 1.004, 1.02, 2, 2.009, rng.random() * 5]), 1) for _ in range(n)]


def brute(rows):
    sells = [(t, w) for t, s, w, _, _ in rows if s == "sell"]
    lock = {tuple(sorted((a[1], b[1]))) for a, b in combinations(sells, 2) if abs(a[0] - b[0]) <= 2 and a[1] != b[1]}
    big = {}
    for _, s, w, sol, _ in rows:
        if s == "buy":
            big[w] = max(big.get(w, 0), sol)
    size = {tuple(sorted((a, b))) for a, b in combinations(big, 2) if abs(big[a] - big[b]) <= min(big[a], big[b]) * 0.005}
    slot = {tuple(sorted((a, b))) for a, b in combinations({(t, w) for t, s, w, _, _ in rows if s == "buy"}, 2) if a[0] == b[0] for a, b in [(a[1], b[1])]}
    return lock, size, slot


def test_links_are_linear_and_keep_components(tape):
    for rows in (random_tape(tape), random_tape(tape, n=400, seconds=20, wallets=60, seed=7)):
        df = tape(rows)
        lock, size, slot = brute(rows)
        for e, full in ((links.lockstep_edges(df), lock), (links.size_edges(df), size), (links.group_edges(links.slot_members(df), ["token_mint", "grp"], "s"), slot)):
            got = e.collect()
            assert len(got) <= 2 * len(rows) and all(r.a < r.b for r in got)
            assert {(r.node, r.comp) for r in connected_components(e, ["token_mint"]).collect()} == set(union_find(full).items())


def test_band_counts_equal_pairs(spark):
    rng = random.Random(9)
    values = {f"w{i:03d}": rng.choice([1.0, 1.004, 1.005, 2.0, 2.009, rng.random() * 5 + 0.01]) for i in range(150)}
    df = spark.createDataFrame([("m", w, v) for w, v in values.items()], "token_mint string, wallet string, v double")
    got = {r.wallet: (r.ahead, r.behind) for r in links.band_counts(df, "v", 0.005).collect()}
    order = sorted(values, key=lambda w: (values[w], w))
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if values[b] <= values[a] * 1.005]
    assert got == {w: (sum(a == w for a, _ in pairs), sum(b == w for _, b in pairs)) for w in values}


def test_group_of_thousands_keeps_exact_measures(spark):
    """One slot with 5,000 wallets: 4,999 links that state all pairs and degrees."""
    data = [("m", f"w{i:04d}", "buy", 1.0, 1.0, 0, 0, 1.0, f"{i}", 0, 0) for i in range(5000)]
    df = spark.createDataFrame(data, "token_mint string, signer string, side string, sol_amount double, token_amount double, ts long, slot long, price_usd double, tx_signature string, created_at long, graduated_at long")
    edges = links.group_edges(links.slot_members(df), ["token_mint", "grp"], "same_slot")
    assert edges.count() == 4999
    shape = entities.graph_shape(edges, df, 3).first()
    assert (shape.n_components, shape.largest_comp_share, shape.sel_density, shape.max_degree_ratio) == (1, 1.0, 1.0, 1.0)
    accum = df.select("token_mint", F.col("signer").alias("wallet"), F.lit(1.0).alias("total_sol_in"))
    topo = entities.topology(df, accum, spark.createDataFrame([], "wallet string, funder string")).first()
    assert (topo.topo_nodes, topo.topo_same_slot_edges, topo.topo_size_edges) == (5000, 12497500, 12497500)
    assert topo.topo_components == 1 and topo.topo_centralization == 0


def test_bundle_rules(tape):
    df = tape([(500, "buy", "a", 1, 1), (500, "buy", "a", 1, 1), (501, "buy", "b", 1, 1), (501, "sell", "c", 1, 1)])
    assert links.bundles(links.slot_groups(df, 0)).count() == 0
    assert links.bundles(links.slot_groups(df, 1)).first().n_wallets == 2


def test_cosine_edges(spark, tape):
    rng = random.Random(8)
    vec = {f"w{i:02d}": [rng.random() * rng.choice([0, 1]) for _ in range(9)] for i in range(40)}
    vec["w00"] = vec["w01"] = [0.5] * 9
    vec["w02"] = [0.01] * 9
    df = tape([(i, "buy", w, 1, 1) for i, w in enumerate(vec)])
    v = spark.createDataFrame([(w, *xs) for w, xs in vec.items()], "wallet string, " + ", ".join(f"v{i} double" for i in range(9)))
    norm = lambda x: sum(a * a for a in x) ** 0.5
    want = {(a, b) for a, b in combinations(sorted(vec), 2) if min(norm(vec[a]), norm(vec[b])) > 0.1
            and sum(x * y for x, y in zip(vec[a], vec[b])) / norm(vec[a]) / norm(vec[b]) >= 0.92}
    edges = links.behavioral_edges(df, v)
    got = {(r.a, r.b) for r in edges.collect()}
    assert ("w00", "w01") in got and not any("w02" in p for p in got)
    assert {(r.node, r.comp) for r in connected_components(edges, ["token_mint"]).collect()} == set(union_find(want).items())
    assert got <= want
    assert edges.filter(F.col("a") >= F.col("b")).count() == 0
