"""Registry of checked queries: a Spark builder and, where possible, its SQL twin.

SQL twins are written over named common table expressions (``t_*``). `compose`
collects the ones a body mentions, transitively, and emits one WITH clause.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapelens.sources.tables import ANCHOR_DELAY, HOUR_S, TOP_HOLDERS, Tables

CTES: dict[str, str] = {}
TAPE_CTES: dict[str, dict[str, str]] = {"t": {}, "e": {}}


def cte(name: str, sql: str, tape: str | None = None) -> None:
    if tape:
        TAPE_CTES[tape][name] = sql
    else:
        CTES[name] = sql


def _lookup(name: str, tape: str) -> str | None:
    return TAPE_CTES[tape].get(name, CTES.get(name))


def compose(body: str, tape: str = "t") -> str:
    """Body plus a WITH clause of every CTE it needs, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for name in sorted(set(re.findall(r"\bt_\w+\b", sql))):
            text = _lookup(name, tape)
            if text is not None and name not in seen:
                seen.add(name)
                visit(text)
                order.append(name)

    visit(body)
    if not order:
        return body
    parts = []
    for n in order:
        text = _lookup(n, tape)
        m = re.match(r"\s*COLUMNS\((.*?)\)\s*AS", text)
        head = f"{n}({m.group(1)})" if m else n
        parts.append(f"{head} AS (\n{text[m.end():] if m else text}\n)")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    tape: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, tape: str = "t", sql: str | None = None):
    """Register a builder taking `Tables`; `sql` is its twin over the same tables."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, tape, sql)
        return fn
    return wrap


# ── shared table expressions ─────────────────────────────────────────────────
cte("t_swaps", """
SELECT CAST(l_partkey AS VARCHAR) AS token_mint, CAST(o_custkey AS VARCHAR) AS signer,
       CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
       l_extendedprice / 1000 AS sol_amount, l_quantity AS token_amount,
       CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS ts,
       CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS slot,
       concat(l_orderkey, '-', l_linenumber) AS tx_signature,
       (l_extendedprice / 1000) / l_quantity AS price_usd
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", "t")
cte("t_swaps", """
SELECT json_extract_string(props, '$.k') AS token_mint, CAST(user_id AS VARCHAR) AS signer,
       CASE WHEN event_type = 'error' THEN 'sell' ELSE 'buy' END AS side,
       value AS sol_amount, CAST(event_id % 97 + 1 AS DOUBLE) AS token_amount,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 600000000 AS ts,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 600000000 AS slot,
       CAST(event_id AS VARCHAR) AS tx_signature,
       value / CAST(event_id % 97 + 1 AS DOUBLE) AS price_usd
FROM events WHERE event_type IN ('error', 'purchase', 'signup')""", "e")
for _tape in ("t", "e"):
    cte("t_coins", f"""
SELECT token_mint, min(ts) AS created_at, min(ts) + {ANCHOR_DELAY[_tape]} AS graduated_at
FROM t_swaps GROUP BY token_mint""", _tape)
cte("t_phased", "SELECT s.*, c.created_at, c.graduated_at FROM t_swaps s JOIN t_coins c USING (token_mint)")
cte("t_bc", "SELECT * FROM t_phased WHERE ts < graduated_at")
cte("t_post", "SELECT * FROM t_phased WHERE ts >= graduated_at")


def dsum(expr: str, digits: int | None = None) -> str:
    """Exact sum in SQL, matching `exact_sum`."""
    total = f"sum(CAST({expr} AS DECIMAL(28,9)))"
    return f"CAST({total if digits is None else f'round({total}, {digits})'} AS DOUBLE)"


cte("t_balances", f"""
SELECT * FROM (SELECT token_mint, signer AS wallet,
  {dsum("CASE WHEN side = 'buy' THEN token_amount ELSE -token_amount END")} AS amount
  FROM t_bc GROUP BY 1, 2) WHERE amount > 0""")
cte("t_supply", f"SELECT token_mint, {dsum('amount')} AS total_supply FROM t_balances GROUP BY 1")
cte("t_holders", f"""
SELECT b.*, total_supply, round(amount / total_supply * 100, 2) AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY token_mint ORDER BY amount DESC, wallet) AS rank
  FROM t_balances) b JOIN t_supply USING (token_mint) WHERE rank <= {TOP_HOLDERS}""")
cte("t_buyers", f"""
SELECT token_mint, signer AS wallet, min(ts) AS bought_at, {dsum('sol_amount')} AS sol_amount,
       {dsum('token_amount')} AS tokens_received
FROM t_bc WHERE side = 'buy' GROUP BY 1, 2""")
cte("t_held", """SELECT b.token_mint, b.wallet, b.amount, round(b.amount / s.total_supply * 100, 2) AS pct, h.rank
FROM t_balances b JOIN t_supply s ON s.token_mint = b.token_mint LEFT JOIN t_holders h ON h.token_mint = b.token_mint AND h.wallet = b.wallet""")
cte("t_team", """
SELECT h.token_mint, h.wallet, h.pct, h.amount FROM t_held h
WHERE EXISTS (SELECT 1 FROM t_buyers b WHERE b.token_mint = h.token_mint AND b.wallet = h.wallet)""")
cte("t_team_clusters", f"""
SELECT m.token_mint, count(*) AS member_count, round({dsum('pct')}, 2) AS supply_pct,
       CAST(min(b.bought_at) - any_value(f.launch_ts) AS DOUBLE) AS first_buy_offset_s,
       CASE WHEN min(b.bought_at) - any_value(f.launch_ts) <= 30 THEN 1 ELSE 0 END AS is_bc_sniper
FROM t_team m JOIN t_buyers b USING (token_mint, wallet)
JOIN (SELECT token_mint, min(bought_at) AS launch_ts FROM t_buyers GROUP BY 1) f USING (token_mint)
GROUP BY 1""")
cte("t_funding", """
SELECT CAST(c_custkey AS VARCHAR) AS wallet,
       CASE WHEN n_regionkey = 0 THEN 'cex' ELSE concat('F', c_nationkey) END AS funder,
       c_acctbal AS sol_funded, first_seen, coalesce(sig_count, 0) AS sig_count
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, min(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)) AS first_seen,
                  count(*) AS sig_count FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
cte("t_cex", "SELECT CAST(c_custkey AS VARCHAR) AS wallet FROM customer WHERE c_custkey % 100 = 0")
cte("t_creators", """
SELECT CAST(l_partkey AS VARCHAR) AS token_mint, concat('S', l_suppkey) AS creator,
       CASE WHEN n_regionkey = 0 THEN 'cex' ELSE concat('F', s_nationkey) END AS creator_funder
FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS rn
      FROM lineitem GROUP BY 1, 2) u
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE rn = 1""")
cte("t_tokens", """
SELECT CAST(p_partkey AS VARCHAR) AS token_mint, p_name AS name, p_brand AS symbol, p_type, p_size, p_retailprice,
       creator, creator_funder, created_at, graduated_at
FROM part JOIN t_creators cr ON cr.token_mint = CAST(p_partkey AS VARCHAR)
JOIN t_coins c ON c.token_mint = CAST(p_partkey AS VARCHAR)""")
cte("t_first_prices", """
SELECT token_mint, arg_min(price_usd, (ts, price_usd)) AS first_price, min(ts) AS first_ts, max(ts) AS last_ts,
       count(*) AS n_price_points, any_value(graduated_at) AS graduated_at
FROM t_post GROUP BY 1""")
cte("t_outcomes", f"""
SELECT token_mint, check_offset_h, price, launch_price, (price / launch_price - 1) * 100 AS price_change_pct,
       CASE WHEN price / launch_price >= 3 THEN 'moon' WHEN price / launch_price <= 0.30 THEN 'rug' ELSE 'ok' END AS classified
FROM (SELECT token_mint, check_offset_h, arg_max(price_usd, (ts, price_usd)) AS price,
             arg_min(price_usd, (ts, price_usd)) AS launch_price
      FROM t_post CROSS JOIN (VALUES (1), (4), (24)) h(check_offset_h)
      WHERE ts <= graduated_at + check_offset_h * {HOUR_S} GROUP BY 1, 2)""")
cte("t_coin_funder", """
SELECT token_mint, funder FROM (
  SELECT token_mint, funder, row_number() OVER (PARTITION BY token_mint ORDER BY count(*) DESC, funder) AS rn
  FROM t_team JOIN t_funding USING (wallet) WHERE funder <> 'cex' GROUP BY 1, 2) WHERE rn = 1""")
