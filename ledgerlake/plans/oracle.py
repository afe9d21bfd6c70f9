"""DuckDB SQL building blocks mirroring the Spark expressions, for the
independent oracle check of every registered query.

Parity rules: money stays DECIMAL until the output cast to DECIMAL(38,2);
2-dp means are rounded HALF_UP with exact integer arithmetic (DuckDB's
decimal division returns DOUBLE); shares are unrounded doubles built from the
same IEEE operations on both sides.
"""

from __future__ import annotations

MICROS_PER_DAY = 86_400_000_000


def ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"


def floor_days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / {MICROS_PER_DAY}) AS BIGINT)"


def money(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(38,2))"


def mean_2dp(total: str, n: str) -> str:
    """HALF_UP (away from zero) 2-dp mean of a 2-dp decimal total."""
    cents = f"CAST(({total}) * 100 AS HUGEINT)"
    q = f"(sign({cents}) * ((2 * abs({cents}) + ({n})) // (2 * ({n}))))"
    return f"CASE WHEN ({n}) > 0 THEN CAST(CAST({q} AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(38,2)) END"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN CAST({part} AS DOUBLE) * 100 / ({whole}) ELSE 0.0 END"


def orders_txn() -> str:
    return """
    SELECT CAST(o.o_custkey AS VARCHAR) AS account_number,
           CAST(o.o_orderdate AS TIMESTAMP) AS transaction_date,
           CASE WHEN o.o_orderkey % 89 = 0 THEN NULL
                ELSE c.c_mktsegment || ' ' || o.o_orderpriority || (['', ' LTD', ' PLC', ' CD 12'])[o.o_orderkey % 4 + 1]
           END AS main_description,
           '' AS additional_description,
           o.o_orderstatus AS transaction_type,
           CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
                WHEN o.o_orderkey % 83 = 0 THEN CAST(0 AS DECIMAL(18,2))
                WHEN o.o_orderkey % 71 = 0 THEN CAST(10 AS DECIMAL(18,2))
                WHEN o.o_orderkey % 1999 = 0 THEN CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * 50 AS DECIMAL(18,2))
                WHEN o.o_orderstatus = 'F' THEN -CAST(o.o_totalprice AS DECIMAL(18,2))
                ELSE CAST(o.o_totalprice AS DECIMAL(18,2)) END AS amount,
           CAST(NULL AS DECIMAL(18,2)) AS balance,
           c.c_mktsegment AS spend_category,
           CASE WHEN n.n_regionkey = 0 THEN 'EUR' ELSE 'GBP' END AS currency,
           CAST(o.o_orderkey AS BIGINT) AS row_id
    FROM orders o
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    """


def events_txn() -> str:
    return """
    SELECT account_number, transaction_date, main_description, additional_description, transaction_type, amount,
           CAST(1000 + sum(amount) OVER (PARTITION BY account_number ORDER BY transaction_date, row_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                + CASE WHEN row_id % 997 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS balance,
           spend_category, currency, row_id
    FROM (
      SELECT CAST(user_id AS VARCHAR) AS account_number,
             CAST(ts AS TIMESTAMP) AS transaction_date,
             event_type AS main_description,
             '' AS additional_description,
             'UNKNOWN' AS transaction_type,
             CASE WHEN event_type IN ('purchase', 'error') THEN -CAST(value AS DECIMAL(18,2))
                  ELSE CAST(value AS DECIMAL(18,2)) END AS amount,
             'UNCATEGORIZED' AS spend_category,
             'GBP' AS currency,
             CAST(event_id AS BIGINT) AS row_id
      FROM events
    ) b
    """


def lineitem_txn() -> str:
    return """
    SELECT CAST(l.l_suppkey AS VARCHAR) AS account_number,
           CAST(l.l_shipdate AS TIMESTAMP) AS transaction_date,
           p.p_name AS main_description,
           '' AS additional_description,
           l.l_linestatus AS transaction_type,
           CASE WHEN l.l_returnflag = 'R' THEN -CAST(l.l_extendedprice AS DECIMAL(18,2))
                ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS amount,
           CAST(NULL AS DECIMAL(18,2)) AS balance,
           'UNCATEGORIZED' AS spend_category,
           'GBP' AS currency,
           CAST(l.l_orderkey * 8 + l.l_linenumber AS BIGINT) AS row_id
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
    """


def supplier_txn() -> str:
    return """
    SELECT CAST(l.l_orderkey % 10 AS VARCHAR) AS account_number,
           CAST(l.l_shipdate AS TIMESTAMP) AS transaction_date,
           s.s_name AS main_description,
           '' AS additional_description,
           l.l_linestatus AS transaction_type,
           CASE WHEN l.l_returnflag = 'R' THEN -CAST(l.l_extendedprice AS DECIMAL(18,2))
                ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS amount,
           CAST(NULL AS DECIMAL(18,2)) AS balance,
           'UNCATEGORIZED' AS spend_category,
           'GBP' AS currency,
           CAST(l.l_orderkey * 8 + l.l_linenumber AS BIGINT) AS row_id
    FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
    """


TXN = {"orders": orders_txn, "events": events_txn, "lineitem": lineitem_txn, "supplier": supplier_txn}


def with_txn(source: str, body: str, extra_ctes: str = "") -> str:
    ctes = f"txn AS ({TXN[source]()})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"
