"""Registration, and the derived frames as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def bars_sql(name: str, hours: int, asset: str = "event_type") -> str:
    return f"""{name} AS (
  SELECT {asset} AS asset, time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '2000-01-01') AS event_time,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume,
         count(*) AS trades, sum(value * value) AS quote_volume, sum(CASE WHEN event_id % 2 = 0 THEN value END) AS taker_buy_base,
         time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '2000-01-01') + INTERVAL {hours} HOUR AS available_time
  FROM events GROUP BY ALL)"""


CTES = {
    "b1": bars_sql("b1", 1), "b4": bars_sql("b4", 4), "b24": bars_sql("b24", 24), "wide": bars_sql("wide", 4, "'u' || (user_id % 16)"),
    "funding": "funding AS (SELECT event_type AS asset, ts AS event_time, ts AS available_time, (value - 35) / 1e5 AS funding_rate, 8 AS funding_interval_hours FROM events WHERE event_id % 8 = 0)",
    "oi": "oi AS (SELECT event_type AS asset, ts AS event_time, ts + INTERVAL 5 MINUTE AS available_time, value + 1000 AS open_interest, value * 1000 AS sum_open_interest_value FROM events WHERE event_id % 5 = 0)",
    "members": "members AS (SELECT asset, selection_time, rank FROM (SELECT asset, selection_time, row_number() OVER (PARTITION BY selection_time ORDER BY v DESC, asset) AS rank FROM (SELECT event_type AS asset, date_trunc('day', ts) + INTERVAL 1 DAY AS selection_time, sum(value) AS v FROM events GROUP BY ALL)) WHERE rank <= 3)",
    "hist": "hist AS (SELECT l_suppkey AS asset, l_shipdate AS event_time, avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)",
    "trades": "trades AS (SELECT l_extendedprice * (l_discount - 0.05) AS pnl, l_returnflag AS outcome, l_shipdate AS exit_time, l_suppkey AS asset, l_orderkey AS trade_id, l_linenumber AS leg FROM lineitem)",
    "decisions": "decisions AS (SELECT o_custkey AS run_id, o_orderdate AS slot, o_totalprice AS equity_after, o_orderkey AS seq FROM orders)",
    "props": "props AS (SELECT doc_id AS factor_id, text AS formula, source AS research_family, lang AS mechanism FROM documents)",
}


def with_(*names: str, more: str = "") -> str:
    return "WITH " + ",\n".join([*(CTES[n] for n in names), *([more] if more else [])]) + "\n"


def add(name: str, sql: str | None = None):
    """Register a query, and the SQL that it equals."""

    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


def r8(x: Column | str, name: str | None = None) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, 8).alias(name or x)


def ts(x: Column | str, name: str | None = None) -> Column:
    """A time as text, the same in every session."""
    c = F.col(x) if isinstance(x, str) else x
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or x)


def tsq(x: str, name: str | None = None) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S') AS {name or x}"


def rq(x: str, name: str | None = None) -> str:
    return f"round({x}, 8) AS {name or x}"
