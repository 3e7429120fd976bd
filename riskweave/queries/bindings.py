"""The seven loan tables, each derived from a whole standard table.

Every binding is one SELECT in the SQL that Spark and the comparison engine share. Amounts
are whole numbers, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table


def _day(ts: str) -> str:
    """Days on a 365-day calendar, counted from the end of 2001."""
    return f"CAST((year({ts}) - 2002) * 365 + (month({ts}) - 1) * 30 + day({ts}) AS INT)"


def _whole(x: str) -> str:
    return f"CAST(floor({x}) AS DOUBLE)"


BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "application": (
        ("customer",),
        f"""
        SELECT c_custkey AS SK_ID_CURR,
          CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET,
          CASE WHEN c_nationkey = 24 THEN 'XNA' WHEN c_nationkey = 23 THEN NULL
               WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS CODE_GENDER,
          CASE WHEN c_nationkey % 3 = 0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
          CASE WHEN c_nationkey % 5 = 1 THEN NULL
               WHEN c_nationkey % 5 < 3 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
          c_mktsegment AS NAME_CONTRACT_TYPE,
          CASE WHEN c_nationkey = 7 THEN 365243
               ELSE CAST(-(c_custkey * 53 % 9000) AS INT) END AS DAYS_EMPLOYED,
          CAST(-(7000 + c_custkey * 37 % 18000) AS INT) AS DAYS_BIRTH,
          {_whole("abs(c_acctbal)")} AS AMT_INCOME_TOTAL,
          CASE WHEN c_custkey % 13 = 0 THEN CAST(0 AS DOUBLE)
               ELSE CAST(1000 + c_custkey * 71 % 9000 AS DOUBLE) END AS AMT_CREDIT,
          CASE WHEN c_custkey % 17 = 0 THEN NULL
               ELSE CAST(c_custkey * 29 % 900 AS DOUBLE) END AS AMT_ANNUITY,
          CASE WHEN c_nationkey % 6 = 5 THEN NULL
               ELSE CAST(c_nationkey % 6 AS DOUBLE) END AS CNT_FAM_MEMBERS,
          CASE WHEN c_custkey % 3 = 0 THEN NULL
               ELSE CAST(c_custkey % 97 AS DOUBLE) / 97 END AS EXT_SOURCE_1,
          CASE WHEN c_custkey % 5 = 0 THEN NULL
               ELSE CAST(c_custkey * 7 % 89 AS DOUBLE) / 89 END AS EXT_SOURCE_2,
          CASE WHEN c_custkey % 7 = 0 THEN NULL
               ELSE CAST(c_custkey * 11 % 83 AS DOUBLE) / 83 END AS EXT_SOURCE_3
        FROM {{customer}}
        """,
    ),
    "bureau": (
        ("orders",),
        f"""
        SELECT o_custkey AS SK_ID_CURR,
          o_orderkey AS SK_ID_BUREAU,
          CASE WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'F' THEN 'Closed'
               ELSE 'Sold' END AS CREDIT_ACTIVE,
          CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS CREDIT_TYPE,
          {_day("o_orderdate")} AS DAYS_CREDIT,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL
               ELSE {_day("o_orderdate")} + CAST(o_orderkey % 700 AS INT) END AS DAYS_CREDIT_ENDDATE,
          {_day("o_orderdate")} + CAST(o_orderkey % 50 AS INT) AS DAYS_CREDIT_UPDATE,
          CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey % 90 AS INT) ELSE 0 END AS CREDIT_DAY_OVERDUE,
          CASE WHEN o_orderkey % 3 = 0 THEN {_whole("o_totalprice / 100")} END AS AMT_CREDIT_MAX_OVERDUE,
          CASE WHEN o_orderkey % 31 = 0 THEN CAST(0 AS DOUBLE)
               ELSE {_whole("o_totalprice")} END AS AMT_CREDIT_SUM,
          CASE WHEN o_orderkey % 6 = 1 THEN NULL WHEN o_orderkey % 62 = 0 THEN CAST(0 AS DOUBLE)
               ELSE {_whole("o_totalprice / 3")} END AS AMT_CREDIT_SUM_DEBT,
          CASE WHEN o_orderkey % 10 = 0 THEN CAST(100 AS DOUBLE)
               ELSE CAST(0 AS DOUBLE) END AS AMT_CREDIT_SUM_OVERDUE,
          CASE WHEN o_orderkey % 8 = 0 THEN {_whole("o_totalprice / 5")} END AS AMT_CREDIT_SUM_LIMIT,
          CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE {_whole("o_totalprice / 20")} END AS AMT_ANNUITY,
          CAST(o_orderkey % 3 AS INT) AS CNT_CREDIT_PROLONG
        FROM {{orders}}
        """,
    ),
    "bureau_balance": (
        ("lineitem",),
        """
        SELECT l_orderkey AS SK_ID_BUREAU,
          CAST((year(l_shipdate) - 2002) * 12 + month(l_shipdate) AS INT) AS MONTHS_BALANCE,
          CASE WHEN l_quantity = 50 THEN NULL ELSE l_returnflag END AS STATUS
        FROM {lineitem}
        """,
    ),
    "previous_application": (
        ("orders",),
        f"""
        SELECT o_custkey AS SK_ID_CURR,
          o_orderkey AS SK_ID_PREV,
          CASE WHEN o_orderstatus = 'F' THEN 'Approved' WHEN o_orderstatus = 'O' THEN 'Refused'
               ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
          CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS NAME_CONTRACT_TYPE,
          CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {_whole("o_totalprice / 25")} END AS AMT_ANNUITY,
          CASE WHEN o_orderkey % 37 = 0 THEN CAST(0 AS DOUBLE)
               ELSE {_whole("o_totalprice / 2")} END AS AMT_APPLICATION,
          CASE WHEN o_orderkey % 74 = 0 THEN CAST(0 AS DOUBLE)
               ELSE {_whole("o_totalprice / 2")} + CAST(o_orderkey % 400 AS DOUBLE) END AS AMT_CREDIT,
          CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE {_whole("o_totalprice / 15")} END AS AMT_DOWN_PAYMENT,
          {_whole("o_totalprice / 2")} AS AMT_GOODS_PRICE,
          CAST(o_orderkey % 24 AS INT) AS HOUR_APPR_PROCESS_START,
          CASE WHEN o_orderkey % 2 = 0 THEN NULL
               ELSE CAST(o_orderkey % 8 AS DOUBLE) / 8 END AS RATE_DOWN_PAYMENT,
          {_day("o_orderdate")} AS DAYS_DECISION,
          CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END AS CNT_PAYMENT,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(365243 AS DOUBLE)
               ELSE CAST({_day("o_orderdate")} AS DOUBLE) END AS DAYS_FIRST_DRAWING,
          CASE WHEN o_orderkey % 5 = 0 THEN CAST(365243 AS DOUBLE)
               ELSE CAST({_day("o_orderdate")} + 30 AS DOUBLE) END AS DAYS_FIRST_DUE,
          CAST({_day("o_orderdate")} + 360 AS DOUBLE) AS DAYS_LAST_DUE_1ST_VERSION,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL
               ELSE CAST({_day("o_orderdate")} + 300 AS DOUBLE) END AS DAYS_LAST_DUE,
          CASE WHEN o_orderkey % 11 = 0 THEN CAST(365243 AS DOUBLE)
               ELSE CAST({_day("o_orderdate")} + 310 AS DOUBLE) END AS DAYS_TERMINATION
        FROM {{orders}}
        """,
    ),
    "pos_cash": (
        ("events",),
        """
        SELECT user_id AS SK_ID_CURR,
          CAST(-day(ts) AS INT) AS MONTHS_BALANCE,
          CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 40 AS INT) ELSE 0 END AS SK_DPD,
          CASE WHEN event_id % 12 = 0 THEN CAST(event_id % 20 AS INT) ELSE 0 END AS SK_DPD_DEF,
          CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_type END AS NAME_CONTRACT_STATUS
        FROM {events}
        """,
    ),
    "installments": (
        ("lineitem", "orders"),
        f"""
        SELECT o_custkey AS SK_ID_CURR,
          CAST(l_linenumber AS DOUBLE) AS NUM_INSTALMENT_VERSION,
          CAST({_day("o_orderdate")} AS DOUBLE) AS DAYS_INSTALMENT,
          CASE WHEN l_quantity = 50 THEN NULL
               ELSE CAST({_day("l_shipdate")} AS DOUBLE) END AS DAYS_ENTRY_PAYMENT,
          CASE WHEN l_quantity = 1 THEN CAST(0 AS DOUBLE)
               ELSE {_whole("l_extendedprice / 100")} END AS AMT_INSTALMENT,
          CASE WHEN l_quantity = 50 THEN NULL
               ELSE {_whole("l_extendedprice * (1 - l_discount) / 100")} END AS AMT_PAYMENT
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
        """,
    ),
    "credit_card": (
        ("events",),
        f"""
        SELECT user_id AS SK_ID_CURR,
          event_id AS SK_ID_PREV,
          CAST(-day(ts) AS INT) AS MONTHS_BALANCE,
          {_whole("value * 10")} AS AMT_BALANCE,
          CAST((event_id % 450) * 10 AS DOUBLE) AS AMT_CREDIT_LIMIT_ACTUAL,
          CASE WHEN event_id % 9 = 0 THEN NULL ELSE {_whole("value")} END AS AMT_DRAWINGS_CURRENT,
          CAST(event_id % 15 AS INT) AS SK_DPD,
          event_type AS NAME_CONTRACT_STATUS
        FROM {{events}}
        """,
    ),
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = BINDINGS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: source(spark, sf_dir, name) for name in BINDINGS}


def source_sql(name: str) -> str:
    tables, sql = BINDINGS[name]
    return sql.format(**{t: t for t in tables})


def with_sources(*names: str) -> str:
    """``WITH name AS (...), ...`` for the SQL side."""
    return "WITH " + ", ".join(f"{n} AS ({source_sql(n)})" for n in names)
