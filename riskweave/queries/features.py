"""Feature engineering: expressions, encodings, rollups, joins and the assembled table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.aggregates import spec_columns
from ..functions.naming import feature_columns
from ..operators import category_table, encode, history, profile, scoring
from ..plans import features as P
from ..session import scratch_path
from ..sources import layout
from .bindings import source, source_sql, sources, with_sources
from .registry import ORACLES, query, table, tidy, tidy_double

# Values the text columns of the bindings take, as the SQL side has to spell them out.
CATEGORIES = {
    "NAME_CONTRACT_TYPE_APP": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "PRIORITY": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "CREDIT_ACTIVE": ["Active", "Closed", "Sold"],
    "STATUS": ["A", "N", "R"],
    "PREV_STATUS": ["Approved", "Canceled", "Refused"],
    "EVENT": ["click", "error", "purchase", "signup", "view"],
}


# ---- SQL text helpers -----------------------------------------------------------------


def sql_ratio(a: str, b: str) -> str:
    return (
        f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) "
        f"WHEN {a} < 0 THEN CAST('-inf' AS DOUBLE) END ELSE CAST({a} AS DOUBLE) / {b} END"
    )


def sql_tidy(x: str, digits: int | None = 6) -> str:
    if digits is None:
        return f"CASE WHEN isfinite(CAST({x} AS DOUBLE)) THEN CAST({x} AS DOUBLE) END"
    return f"CASE WHEN isfinite(CAST({x} AS DOUBLE)) THEN round(CAST({x} AS DOUBLE), {digits}) END"


def sql_agg(fn: str, x: str, cond: str | None = None) -> str:
    v = x if cond is None else f"CASE WHEN {cond} THEN {x} END"
    got = None if cond is None else f"count(CASE WHEN {cond} THEN 1 END)"
    if fn == "size":
        return "count(*)" if cond is None else f"nullif({got}, 0)"
    if fn == "sum":
        s = f"coalesce(sum({v}), 0)"
        return s if cond is None else f"CASE WHEN {got} > 0 THEN {s} END"
    if fn == "nunique":
        return f"count(DISTINCT {v})"
    name = {"min": "min", "max": "max", "mean": "avg", "var": "var_samp"}[fn]
    return f"{name}(CAST({v} AS DOUBLE))"


def places(name: str) -> int:
    """Decimals to compare: fewer for variances of large amounts."""
    if name.endswith("_VAR"):
        return 4 if "DAYS_CREDIT" in name else 5 if "AMT_" in name else 6
    return 6


def sql_spec(spec, prefix: str, cond: str | None = None) -> list[str]:
    parts = []
    for c, fns in spec.items():
        for fn in fns:
            name = f"{prefix}{c}_{fn.upper()}"
            value = sql_agg(fn, '"' + c + '"', cond)
            parts.append(f'{sql_tidy(value, places(name))} AS "{name}"')
    return parts


def sql_shares(column: str, values: list[str], prefix: str, digits: int = 6) -> list[str]:
    tests = [(f"{column}_{v}", f"{column} = '{v}'") for v in values]
    tests.append((f"{column}_nan", f"{column} IS NULL"))
    return [
        f'round(avg(CASE WHEN {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), {digits}) AS "{prefix}{n}_MEAN"'
        for n, t in tests
    ]


def sql_rollup(relation: str, key: str, parts: list[str]) -> str:
    body = ",\n  ".join(parts)
    return f"SELECT {key},\n  {body}\nFROM {relation} WHERE {key} IS NOT NULL GROUP BY {key}"


BALANCE_BLOCK = """
balance_block AS (
  SELECT SK_ID_BUREAU, min(MONTHS_BALANCE) AS MONTHS_BALANCE_MIN, max(MONTHS_BALANCE) AS MONTHS_BALANCE_MAX,
    count(*) AS MONTHS_BALANCE_SIZE,
    avg(CASE WHEN STATUS = 'A' THEN 1.0::DOUBLE ELSE 0 END) AS STATUS_A_MEAN,
    avg(CASE WHEN STATUS = 'N' THEN 1.0::DOUBLE ELSE 0 END) AS STATUS_N_MEAN,
    avg(CASE WHEN STATUS = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS STATUS_R_MEAN,
    avg(CASE WHEN STATUS IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS STATUS_nan_MEAN
  FROM bureau_balance WHERE SK_ID_BUREAU IS NOT NULL GROUP BY SK_ID_BUREAU)"""

CREDITS = (
    with_sources("bureau", "bureau_balance")
    + ","
    + BALANCE_BLOCK
    + f""",
credits AS (
  SELECT b.* EXCLUDE (SK_ID_BUREAU), m.* EXCLUDE (SK_ID_BUREAU),
    {sql_ratio("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM")} AS DEBT_PERCENTAGE,
    {sql_ratio("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM")} AS OVERDUE_PERCENTAGE
  FROM bureau b LEFT JOIN balance_block m ON b.SK_ID_BUREAU = m.SK_ID_BUREAU)
"""
)

_MONTH_SHARES = {f"STATUS_{v}_MEAN": ["mean"] for v in ["A", "N", "R", "nan"]}


def _bureau_parts() -> list[str]:
    return (
        sql_spec(P.BUREAU_SPEC, "BURO_")
        + sql_spec(_MONTH_SHARES, "BURO_")
        + sql_shares("CREDIT_ACTIVE", CATEGORIES["CREDIT_ACTIVE"], "BURO_")
        + sql_shares("CREDIT_TYPE", CATEGORIES["PRIORITY"], "BURO_")
        + sql_spec(P.BUREAU_SPEC, "ACTIVE_", "CREDIT_ACTIVE = 'Active'")
        + sql_spec(P.BUREAU_SPEC, "CLOSED_", "CREDIT_ACTIVE = 'Closed'")
    )


PREVIOUS = with_sources("previous_application") + (
    ", prev AS (SELECT *, "
    + sql_ratio("AMT_CREDIT", "AMT_APPLICATION")
    + " AS CREDIT_APP_PERC, "
    + sql_ratio("AMT_DOWN_PAYMENT", "AMT_CREDIT")
    + " AS DOWN_PAYMENT_CREDIT_RATIO FROM previous_application)\n"
)


def _previous_parts() -> list[str]:
    return (
        sql_spec(P.PREVIOUS_SPEC, "PREV_")
        + sql_shares("NAME_CONTRACT_STATUS", CATEGORIES["PREV_STATUS"], "PREV_")
        + sql_shares("NAME_CONTRACT_TYPE", CATEGORIES["PRIORITY"], "PREV_")
        + sql_spec(P.PREVIOUS_SPEC, "APPROVED_", "NAME_CONTRACT_STATUS = 'Approved'")
        + sql_spec(P.PREVIOUS_SPEC, "REFUSED_", "NAME_CONTRACT_STATUS = 'Refused'")
    )


PAYMENTS = with_sources("installments") + (
    f""", pay0 AS (
  SELECT *, {sql_ratio("AMT_PAYMENT", "AMT_INSTALMENT")} AS PAYMENT_PERC,
    AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
    CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 THEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT ELSE 0 END AS DPD,
    CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT > 0 THEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT ELSE 0 END AS DBD
  FROM installments),
pay AS (SELECT *, CASE WHEN DPD > 0 THEN 1 ELSE 0 END AS LATE_PAYMENT_FLAG FROM pay0)
"""
)


def _installment_parts() -> list[str]:
    return sql_spec(P.INSTALLMENT_SPEC, "INSTAL_") + ['CAST(count(*) AS DOUBLE) AS "INSTAL_COUNT"']


def _pos_parts() -> list[str]:
    return (
        sql_spec(P.POS_SPEC, "POS_")
        + sql_shares("NAME_CONTRACT_STATUS", CATEGORIES["EVENT"], "POS_")
        + ['CAST(count(*) AS DOUBLE) AS "POS_COUNT"']
    )


CARDS = with_sources("credit_card") + (
    ", cc AS (SELECT * EXCLUDE (SK_ID_PREV), "
    + sql_ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")
    + " AS BALANCE_LIMIT_RATIO"
    + "".join(
        f', CASE WHEN NAME_CONTRACT_STATUS = \'{v}\' THEN 1 ELSE 0 END AS "NAME_CONTRACT_STATUS_{v}"'
        for v in CATEGORIES["EVENT"]
    )
    + ", CASE WHEN NAME_CONTRACT_STATUS IS NULL THEN 1 ELSE 0 END AS NAME_CONTRACT_STATUS_nan FROM credit_card)\n"
)
_CARD_NUMBERS = [
    "MONTHS_BALANCE",
    "AMT_BALANCE",
    "AMT_CREDIT_LIMIT_ACTUAL",
    "AMT_DRAWINGS_CURRENT",
    "SK_DPD",
    "BALANCE_LIMIT_RATIO",
]
_CARD_DUMMIES = [f"NAME_CONTRACT_STATUS_{v}" for v in [*CATEGORIES["EVENT"], "nan"]]


def _card_parts() -> list[str]:
    spec = {c: ["min", "max", "mean", "sum", "var"] for c in _CARD_NUMBERS + _CARD_DUMMIES}
    return sql_spec(spec, "CC_") + ['CAST(count(*) AS DOUBLE) AS "CC_COUNT"']


_APP_VALUES = f"""
    CASE WHEN DAYS_EMPLOYED = 365243 THEN 1 ELSE 0 END AS DAYS_EMPLOYED_ANOM,
    nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED
"""

_LABEL_SQL = """
{c}_codes AS (
  SELECT {c} AS v, row_number() OVER (ORDER BY min(SK_ID_CURR), {c}) - 1 AS code
  FROM valid WHERE {c} IS NOT NULL GROUP BY {c})"""

APPLICATION = (
    with_sources("application")
    + ", valid AS (SELECT * FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'),"
    + ",".join(_LABEL_SQL.format(c=c) for c in P.BINARY_LABELS)
    + f""",
cleared AS (
  SELECT v.* EXCLUDE (CODE_GENDER, FLAG_OWN_CAR, FLAG_OWN_REALTY, NAME_CONTRACT_TYPE, DAYS_EMPLOYED),
    coalesce(g.code, -1) AS CODE_GENDER, coalesce(k.code, -1) AS FLAG_OWN_CAR, coalesce(r.code, -1) AS FLAG_OWN_REALTY,
    {", ".join(f"CASE WHEN NAME_CONTRACT_TYPE = '{v}' THEN 1 ELSE 0 END AS NAME_CONTRACT_TYPE_{v}" for v in CATEGORIES["NAME_CONTRACT_TYPE_APP"])},
    {_APP_VALUES}
  FROM valid v LEFT JOIN CODE_GENDER_codes g ON v.CODE_GENDER = g.v
    LEFT JOIN FLAG_OWN_CAR_codes k ON v.FLAG_OWN_CAR = k.v
    LEFT JOIN FLAG_OWN_REALTY_codes r ON v.FLAG_OWN_REALTY = r.v),
enriched AS (
  SELECT *,
    {sql_ratio("DAYS_EMPLOYED", "DAYS_BIRTH")} AS DAYS_EMPLOYED_PERC,
    {sql_ratio("AMT_INCOME_TOTAL", "AMT_CREDIT")} AS INCOME_CREDIT_PERC,
    {sql_ratio("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS")} AS INCOME_PER_PERSON,
    {sql_ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL")} AS ANNUITY_INCOME_PERC,
    {sql_ratio("AMT_ANNUITY", "AMT_CREDIT")} AS PAYMENT_RATE,
    list_avg([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3]) AS EXT_SOURCE_MEAN,
    list_stddev_samp([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3]) AS EXT_SOURCE_STD
  FROM cleared)
"""
)
_APP_COLUMNS = [
    "TARGET", "DAYS_BIRTH", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CNT_FAM_MEMBERS",
    "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY",
    *[f"NAME_CONTRACT_TYPE_{v}" for v in CATEGORIES["NAME_CONTRACT_TYPE_APP"]],
    "DAYS_EMPLOYED_ANOM", "DAYS_EMPLOYED", "DAYS_EMPLOYED_PERC", "INCOME_CREDIT_PERC", "INCOME_PER_PERSON",
    "ANNUITY_INCOME_PERC", "PAYMENT_RATE", "EXT_SOURCE_MEAN", "EXT_SOURCE_STD",
]


def _application_sql(columns: list[str] = _APP_COLUMNS) -> str:
    return "SELECT SK_ID_CURR, " + ", ".join(f"{sql_tidy(c)} AS {c}" for c in columns) + " FROM enriched"


def _dataset_sql() -> str:
    """All blocks as CTEs of one statement; the per-block WITH keywords are merged."""
    ctes = [
        APPLICATION[len("WITH "):],
        CREDITS[len("WITH "):],
        PREVIOUS[len("WITH "):],
        PAYMENTS[len("WITH "):],
        CARDS[len("WITH "):],
        f"pos_cash AS ({source_sql('pos_cash')})",
        f"app_block AS ({_application_sql()})",
        f"buro_block AS ({sql_rollup('credits', 'SK_ID_CURR', _bureau_parts())})",
        f"prev_block AS ({sql_rollup('prev', 'SK_ID_CURR', _previous_parts())})",
        f"pos_block AS ({sql_rollup('pos_cash', 'SK_ID_CURR', _pos_parts())})",
        f"pay_block AS ({sql_rollup('pay', 'SK_ID_CURR', _installment_parts())})",
        f"cc_block AS ({sql_rollup('cc', 'SK_ID_CURR', _card_parts())})",
    ]
    joins = " ".join(
        f"LEFT JOIN {b} USING (SK_ID_CURR)" for b in ["buro_block", "prev_block", "pos_block", "pay_block", "cc_block"]
    )
    return "WITH " + ",\n".join(ctes) + f"\nSELECT * FROM app_block {joins}"


DATASET_SQL = _dataset_sql()


# ---- the assembled table and its blocks -----------------------------------------------


KEY = ["SK_ID_CURR"]


@query("build_dataset", DATASET_SQL)
def build_dataset(spark, sf):
    return tidy_double(P.build_dataset(sources(spark, sf)), KEY, places)


@query(
    "join_feature_blocks",
    with_sources("application", "bureau", "previous_application", "pos_cash", "installments", "credit_card")
    + """
SELECT a.SK_ID_CURR, a.TARGET, b.n_bureau, p.n_prev, s.n_pos, i.n_pay, c.n_card
FROM application a
LEFT JOIN (SELECT SK_ID_CURR, count(*) AS n_bureau FROM bureau GROUP BY 1) b USING (SK_ID_CURR)
LEFT JOIN (SELECT SK_ID_CURR, count(*) AS n_prev FROM previous_application GROUP BY 1) p USING (SK_ID_CURR)
LEFT JOIN (SELECT SK_ID_CURR, count(*) AS n_pos FROM pos_cash GROUP BY 1) s USING (SK_ID_CURR)
LEFT JOIN (SELECT SK_ID_CURR, count(*) AS n_pay FROM installments GROUP BY 1) i USING (SK_ID_CURR)
LEFT JOIN (SELECT SK_ID_CURR, count(*) AS n_card FROM credit_card GROUP BY 1) c USING (SK_ID_CURR)""",
)
def join_feature_blocks(spark, sf):
    names = {
        "bureau": "n_bureau",
        "previous_application": "n_prev",
        "pos_cash": "n_pos",
        "installments": "n_pay",
        "credit_card": "n_card",
    }
    blocks = [history.group_count(source(spark, sf, s), "SK_ID_CURR", n) for s, n in names.items()]
    base = source(spark, sf, "application").select("SK_ID_CURR", "TARGET")
    return P.join_feature_blocks(base, *blocks)


_BUCKETS = 8


@query("join_stored_blocks", ORACLES["join_feature_blocks"])
def join_stored_blocks(spark, sf):
    """The same from tables in buckets of the client key: five groupings and joins without an exchange."""
    names = {
        "bureau": "n_bureau",
        "previous_application": "n_prev",
        "pos_cash": "n_pos",
        "installments": "n_pay",
        "credit_card": "n_card",
    }

    def stored(name):
        path = scratch_path(spark, name)
        # the last part of a scratch path is of letters, digits and hyphens, and used once
        return layout.store_by_key(source(spark, sf, name), path.rpartition("/")[2].replace("-", "_"), path, _BUCKETS)

    blocks = [history.group_count(stored(s), "SK_ID_CURR", n) for s, n in names.items()]
    return P.join_feature_blocks(stored("application").select("SK_ID_CURR", "TARGET"), *blocks)


@query("lookup_stored", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 100 = 7)")
def lookup_stored(spark, sf):
    path = scratch_path(spark, "clients")
    clients = layout.store_by_key(
        table(spark, sf, "customer"), path.rpartition("/")[2].replace("-", "_"), path, _BUCKETS, "c_custkey"
    )
    wanted = table(spark, sf, "orders").where("o_orderkey % 100 = 7").select(F.col("o_custkey").alias("c_custkey"))
    return layout.lookup_stored(clients, wanted, "c_custkey")


@query("application_features", APPLICATION + _application_sql())
def application_features(spark, sf):
    return tidy_double(P.application_features(source(spark, sf, "application")), KEY, 6)


@query(
    "agg_monthly_child",
    with_sources("bureau_balance")
    + ","
    + BALANCE_BLOCK
    + """ SELECT SK_ID_BUREAU, MONTHS_BALANCE_MIN, MONTHS_BALANCE_MAX, MONTHS_BALANCE_SIZE,
    round(STATUS_A_MEAN, 6) AS STATUS_A_MEAN, round(STATUS_N_MEAN, 6) AS STATUS_N_MEAN,
    round(STATUS_R_MEAN, 6) AS STATUS_R_MEAN, round(STATUS_nan_MEAN, 6) AS STATUS_nan_MEAN FROM balance_block""",
)
def agg_monthly_child(spark, sf):
    return tidy(P.balance_by_credit(source(spark, sf, "bureau_balance")), digits=6)


@query(
    "join_child_agg",
    CREDITS
    + f"""SELECT SK_ID_CURR, CREDIT_ACTIVE, DAYS_CREDIT, MONTHS_BALANCE_MIN, MONTHS_BALANCE_MAX, MONTHS_BALANCE_SIZE,
    {sql_tidy("STATUS_nan_MEAN")} AS STATUS_nan_MEAN FROM credits""",
)
def join_child_agg(spark, sf):
    joined = P.bureau_with_balance(source(spark, sf, "bureau"), source(spark, sf, "bureau_balance"))
    names = ["CREDIT_ACTIVE", "DAYS_CREDIT", "MONTHS_BALANCE_MIN", "MONTHS_BALANCE_MAX", "MONTHS_BALANCE_SIZE"]
    return tidy(joined.select("SK_ID_CURR", *names, "STATUS_nan_MEAN"), digits=6)


def _bureau(spark, sf):
    return P.bureau_features(source(spark, sf, "bureau"), source(spark, sf, "bureau_balance"))


def _block(df, *prefixes):
    return tidy_double(df.select("SK_ID_CURR", *[c for c in df.columns if c.startswith(prefixes)]), KEY, places)


@query(
    "agg_bureau",
    CREDITS
    + sql_rollup(
        "credits",
        "SK_ID_CURR",
        sql_spec(P.BUREAU_SPEC, "BURO_")
        + sql_spec(_MONTH_SHARES, "BURO_")
        + sql_shares("CREDIT_ACTIVE", CATEGORIES["CREDIT_ACTIVE"], "BURO_")
        + sql_shares("CREDIT_TYPE", CATEGORIES["PRIORITY"], "BURO_"),
    ),
)
def agg_bureau(spark, sf):
    return _block(_bureau(spark, sf), "BURO_")


def _subset_sql(ctes: str, relation: str, spec, prefix: str, cond: str) -> str:
    """The subset aggregated on its own and joined back to all clients of the history."""
    inner = sql_rollup(f"(SELECT * FROM {relation} WHERE {cond})", "SK_ID_CURR", sql_spec(spec, prefix))
    return f"{ctes} SELECT * FROM (SELECT DISTINCT SK_ID_CURR FROM {relation}) k LEFT JOIN ({inner}) s USING (SK_ID_CURR)"


@query("agg_bureau_active", _subset_sql(CREDITS, "credits", P.BUREAU_SPEC, "ACTIVE_", "CREDIT_ACTIVE = 'Active'"))
def agg_bureau_active(spark, sf):
    return _block(_bureau(spark, sf), "ACTIVE_")


@query("agg_bureau_closed", _subset_sql(CREDITS, "credits", P.BUREAU_SPEC, "CLOSED_", "CREDIT_ACTIVE = 'Closed'"))
def agg_bureau_closed(spark, sf):
    return _block(_bureau(spark, sf), "CLOSED_")


@query(
    "agg_previous",
    PREVIOUS
    + sql_rollup(
        "prev",
        "SK_ID_CURR",
        sql_spec(P.PREVIOUS_SPEC, "PREV_")
        + sql_shares("NAME_CONTRACT_STATUS", CATEGORIES["PREV_STATUS"], "PREV_")
        + sql_shares("NAME_CONTRACT_TYPE", CATEGORIES["PRIORITY"], "PREV_"),
    ),
)
def agg_previous(spark, sf):
    return _block(P.previous_features(source(spark, sf, "previous_application")), "PREV_")


@query(
    "agg_previous_approved",
    _subset_sql(PREVIOUS, "prev", P.PREVIOUS_SPEC, "APPROVED_", "NAME_CONTRACT_STATUS = 'Approved'"),
)
def agg_previous_approved(spark, sf):
    return _block(P.previous_features(source(spark, sf, "previous_application")), "APPROVED_")


@query(
    "agg_previous_refused",
    _subset_sql(PREVIOUS, "prev", P.PREVIOUS_SPEC, "REFUSED_", "NAME_CONTRACT_STATUS = 'Refused'"),
)
def agg_previous_refused(spark, sf):
    return _block(P.previous_features(source(spark, sf, "previous_application")), "REFUSED_")


_SUBSET_SPEC = {"AMT_CREDIT_SUM": ["sum", "size", "max"], "CNT_CREDIT_PROLONG": ["sum", "nunique"]}


@query(
    "join_subset_agg",
    with_sources("bureau")
    + """, a AS (SELECT SK_ID_CURR, count(*) AS ALL_SIZE, sum(AMT_CREDIT_SUM) AS ALL_SUM FROM bureau GROUP BY 1),
s AS (SELECT SK_ID_CURR, sum(AMT_CREDIT_SUM) AS ACTIVE_AMT_CREDIT_SUM_SUM, count(*) AS ACTIVE_AMT_CREDIT_SUM_SIZE,
  max(AMT_CREDIT_SUM) AS ACTIVE_AMT_CREDIT_SUM_MAX, CAST(sum(CNT_CREDIT_PROLONG) AS BIGINT) AS ACTIVE_CNT_CREDIT_PROLONG_SUM,
  count(DISTINCT CNT_CREDIT_PROLONG) AS ACTIVE_CNT_CREDIT_PROLONG_NUNIQUE
  FROM bureau WHERE CREDIT_ACTIVE = 'Active' GROUP BY 1)
SELECT * FROM a LEFT JOIN s USING (SK_ID_CURR)""",
)
def join_subset_agg(spark, sf):
    active = "CREDIT_ACTIVE <=> 'Active'"
    return (
        source(spark, sf, "bureau")
        .groupBy("SK_ID_CURR")
        .agg(
            F.count(F.lit(1)).alias("ALL_SIZE"),
            F.sum("AMT_CREDIT_SUM").alias("ALL_SUM"),
            *spec_columns(_SUBSET_SPEC, "ACTIVE_", active),
        )
    )


@query("agg_pos", with_sources("pos_cash") + sql_rollup("pos_cash", "SK_ID_CURR", _pos_parts()))
def agg_pos(spark, sf):
    return _block(P.pos_features(source(spark, sf, "pos_cash")), "POS_")


@query("agg_installments", PAYMENTS + sql_rollup("pay", "SK_ID_CURR", _installment_parts()))
def agg_installments(spark, sf):
    return _block(P.installment_features(source(spark, sf, "installments")), "INSTAL_")


@query("agg_card_all_columns", CARDS + sql_rollup("cc", "SK_ID_CURR", _card_parts()))
def agg_card_all_columns(spark, sf):
    return _block(P.card_features(source(spark, sf, "credit_card")), "CC_")


_ALL_FUNCTIONS = ["min", "max", "mean", "sum", "var", "size", "nunique"]
_FUNCTION_SPEC = {"tax_or_null": _ALL_FUNCTIONS}


@query(
    "agg_functions",
    "WITH q AS (SELECT l_orderkey, CASE WHEN l_tax > 0.04::DOUBLE THEN l_tax * 100 END AS tax_or_null FROM lineitem) "
    + sql_rollup("q", "l_orderkey", sql_spec(_FUNCTION_SPEC, "")),
)
def agg_functions(spark, sf):
    tax = F.when(F.col("l_tax") > F.lit(0.04), F.col("l_tax") * 100)
    q = table(spark, sf, "lineitem").select("l_orderkey", tax.alias("tax_or_null"))
    return tidy_double(history.rollup(q, "l_orderkey", _FUNCTION_SPEC), ["l_orderkey"], places)


@query("agg_group_count", "SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey")
def agg_group_count(spark, sf):
    return history.group_count(table(spark, sf, "orders"), "o_custkey", "n_rows")


# ---- encoding ---------------------------------------------------------------------------


def _dummy_sql(column: str, values: list[str], dummy_na: bool) -> str:
    parts = [f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS \"{column}_{v}\"" for v in values]
    if dummy_na:
        parts.append(f"CASE WHEN {column} IS NULL THEN 1 ELSE 0 END AS {column}_nan")
    return ", ".join(parts)


@query(
    "one_hot",
    with_sources("bureau")
    + f" SELECT SK_ID_BUREAU, {_dummy_sql('CREDIT_ACTIVE', CATEGORIES['CREDIT_ACTIVE'], True)}, "
    + f"{_dummy_sql('CREDIT_TYPE', CATEGORIES['PRIORITY'], True)} FROM bureau",
)
def one_hot(spark, sf):
    return encode.one_hot(source(spark, sf, "bureau").select("SK_ID_BUREAU", "CREDIT_ACTIVE", "CREDIT_TYPE"))


@query(
    "one_hot_no_null",
    with_sources("application")
    + f" SELECT SK_ID_CURR, {_dummy_sql('NAME_CONTRACT_TYPE', CATEGORIES['NAME_CONTRACT_TYPE_APP'], False)}, "
    + f"{_dummy_sql('FLAG_OWN_REALTY', ['N', 'Y'], False)} FROM application",
)
def one_hot_no_null(spark, sf):
    app = source(spark, sf, "application").select("SK_ID_CURR", "NAME_CONTRACT_TYPE", "FLAG_OWN_REALTY")
    return encode.one_hot(app, dummy_na=False)


@query(
    "one_hot_rate",
    with_sources("previous_application")
    + sql_rollup(
        "previous_application",
        "SK_ID_CURR",
        sql_shares("NAME_CONTRACT_STATUS", CATEGORIES["PREV_STATUS"], "", 6)
        + sql_shares("NAME_CONTRACT_TYPE", CATEGORIES["PRIORITY"], "", 6),
    ),
)
def one_hot_rate(spark, sf):
    return tidy(encode.one_hot_rate(source(spark, sf, "previous_application"), "SK_ID_CURR"), digits=6)


_SHARE_COLUMNS = ["NAME_CONTRACT_STATUS", "NAME_CONTRACT_TYPE"]


@query(
    "category_shares",
    with_sources("previous_application")
    + " UNION ALL ".join(
        f"""SELECT SK_ID_CURR, '{c}' AS "column", {c} AS category, round(count(*) / max(total), 6) AS share
  FROM (SELECT *, count(*) OVER (PARTITION BY SK_ID_CURR) AS total FROM previous_application) q GROUP BY SK_ID_CURR, {c}"""
        for c in _SHARE_COLUMNS
    ),
)
def category_shares(spark, sf):
    """Maps of shares, one entry a row again."""
    maps = category_table.share_maps(source(spark, sf, "previous_application"), "SK_ID_CURR", _SHARE_COLUMNS)

    def entries(c):
        name, nan = F.lit(c).alias("column"), F.col(c + category_table.MISSING)
        known = F.transform(F.map_entries(c), lambda e: F.struct(name, e["key"].alias("category"), e["value"].alias("share")))
        missing = F.struct(name, F.lit(None).cast("string").alias("category"), nan.alias("share"))
        return F.concat(known, F.filter(F.array(missing), lambda e: e["share"] > 0))

    return tidy(maps.select("SK_ID_CURR", F.inline(F.concat(*map(entries, _SHARE_COLUMNS)))), digits=6)


@query(
    "label_codes",
    """WITH f AS (SELECT CAST(l_partkey AS VARCHAR) AS part, min(l_orderkey) AS first FROM lineitem WHERE l_quantity <> 50 GROUP BY 1),
c AS (SELECT part, row_number() OVER (ORDER BY first, part) - 1 AS code FROM f)
SELECT l_orderkey, count(*) AS n, CAST(sum(coalesce(code, -1)) AS BIGINT) AS code_sum, max(coalesce(code, -1)) AS code_max
FROM lineitem LEFT JOIN c ON part = CASE WHEN l_quantity <> 50 THEN CAST(l_partkey AS VARCHAR) END GROUP BY 1""",
)
def label_codes(spark, sf):
    """Codes of a column with as many values as there are parts."""
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey", "CASE WHEN l_quantity <> 50 THEN CAST(l_partkey AS STRING) END AS part")
    coded = category_table.label_encode(lines, category_table.label_table(lines, ["part"], "l_orderkey"), ["part"])
    return coded.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("code_sum"), F.max("part").alias("code_max"))


_DOMAIN_COLUMNS = {
    "application": ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_CONTRACT_TYPE"],
    "bureau": ["CREDIT_ACTIVE", "CREDIT_TYPE"],
    "bureau_balance": ["STATUS"],
    "previous_application": ["NAME_CONTRACT_STATUS", "NAME_CONTRACT_TYPE"],
    "pos_cash": ["NAME_CONTRACT_STATUS"],
    "credit_card": ["NAME_CONTRACT_STATUS"],
}


@query(
    "cat_domain",
    with_sources(*_DOMAIN_COLUMNS)
    + " UNION ALL ".join(
        f"SELECT '{s}' AS source, '{c}' AS \"column\", {c} AS category, count(*) AS n FROM {s} GROUP BY {c}"
        for s, columns in _DOMAIN_COLUMNS.items()
        for c in columns
    ),
)
def cat_domain(spark, sf):
    parts = [encode.category_domain(df, source=name) for name, df in sources(spark, sf).items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query(
    "label_encode",
    APPLICATION + "SELECT SK_ID_CURR, CODE_GENDER, FLAG_OWN_CAR, FLAG_OWN_REALTY FROM cleared",
)
def label_encode(spark, sf):
    app = source(spark, sf, "application").where(N.not_sentinel("CODE_GENDER"))
    coded = encode.label_encode(app, P.BINARY_LABELS, "SK_ID_CURR")
    return coded.select("SK_ID_CURR", *[F.col(c).cast("long").alias(c) for c in P.BINARY_LABELS])


# ---- row-wise expressions ---------------------------------------------------------------


@query(
    "ratio_ieee",
    f"""WITH q AS (SELECT l_orderkey, l_discount - 0.05::DOUBLE AS a, l_tax AS b FROM lineitem),
r AS (SELECT l_orderkey, a, b, {sql_ratio("a", "b")} AS ratio FROM q)
SELECT l_orderkey, count(ratio) AS n_ratio, count(CASE WHEN ratio = CAST('inf' AS DOUBLE) THEN 1 END) AS n_pos_inf,
  count(CASE WHEN ratio = CAST('-inf' AS DOUBLE) THEN 1 END) AS n_neg_inf, {sql_tidy("max(ratio)")} AS max_ratio,
  {sql_tidy("min(ratio)")} AS min_ratio FROM r GROUP BY l_orderkey""",
)
def ratio_ieee(spark, sf):
    q = table(spark, sf, "lineitem").select(
        "l_orderkey", N.ratio_ieee(F.col("l_discount") - F.lit(0.05), "l_tax").alias("ratio")
    )
    grouped = q.groupBy("l_orderkey").agg(
        F.count("ratio").alias("n_ratio"),
        F.count_if(F.col("ratio") == F.lit(float("inf"))).alias("n_pos_inf"),
        F.count_if(F.col("ratio") == F.lit(float("-inf"))).alias("n_neg_inf"),
        F.max("ratio").alias("max_ratio"),
        F.min("ratio").alias("min_ratio"),
    )
    return tidy(grouped, digits=6)


def _select_sql(relation: str, keys: list[str], columns: list[str], digits: int | None = None) -> str:
    return f"SELECT {', '.join(keys)}, " + ", ".join(f"{sql_tidy(c, digits)} AS {c}" for c in columns) + f" FROM {relation}"


_APP_RATIOS = [
    "DAYS_EMPLOYED_PERC", "INCOME_CREDIT_PERC", "INCOME_PER_PERSON", "ANNUITY_INCOME_PERC", "PAYMENT_RATE",
]


@query("app_ratios", APPLICATION + _select_sql("enriched", KEY, _APP_RATIOS))
def app_ratios(spark, sf):
    app = source(spark, sf, "application").where(N.not_sentinel("CODE_GENDER"))
    app = app.withColumn("DAYS_EMPLOYED", N.sentinel_to_null("DAYS_EMPLOYED"))
    return tidy(P.application_ratios(app).select("SK_ID_CURR", *_APP_RATIOS), digits=None)


@query("row_mean", APPLICATION + _select_sql("enriched", KEY, ["EXT_SOURCE_MEAN"], 6))
def row_mean(spark, sf):
    app = source(spark, sf, "application").where(N.not_sentinel("CODE_GENDER"))
    return tidy(P.external_scores(app).select("SK_ID_CURR", "EXT_SOURCE_MEAN"), digits=6)


@query("row_std", APPLICATION + _select_sql("enriched", KEY, ["EXT_SOURCE_STD"], 6))
def row_std(spark, sf):
    app = source(spark, sf, "application").where(N.not_sentinel("CODE_GENDER"))
    return tidy(P.external_scores(app).select("SK_ID_CURR", "EXT_SOURCE_STD"), digits=6)


@query(
    "bureau_ratios",
    with_sources("bureau")
    + ", q AS (SELECT SK_ID_BUREAU, "
    + sql_ratio("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM")
    + " AS DEBT_PERCENTAGE, "
    + sql_ratio("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM")
    + " AS OVERDUE_PERCENTAGE FROM bureau) "
    + _select_sql("q", ["SK_ID_BUREAU"], ["DEBT_PERCENTAGE", "OVERDUE_PERCENTAGE"]),
)
def bureau_ratios(spark, sf):
    q = P.bureau_ratios(source(spark, sf, "bureau"))
    return tidy(q.select("SK_ID_BUREAU", "DEBT_PERCENTAGE", "OVERDUE_PERCENTAGE"), digits=None)


@query(
    "prev_ratios",
    PREVIOUS + _select_sql("prev", ["SK_ID_PREV"], ["CREDIT_APP_PERC", "DOWN_PAYMENT_CREDIT_RATIO"]),
)
def prev_ratios(spark, sf):
    q = P.previous_ratios(source(spark, sf, "previous_application"))
    return tidy(q.select("SK_ID_PREV", "CREDIT_APP_PERC", "DOWN_PAYMENT_CREDIT_RATIO"), digits=None)


def _payments(spark, sf, *columns):
    return tidy_double(P.payment_columns(source(spark, sf, "installments")).select("SK_ID_CURR", *columns), KEY, None)


@query("payment_ratio_diff", PAYMENTS + _select_sql("pay", KEY, ["PAYMENT_PERC", "PAYMENT_DIFF"]))
def payment_ratio_diff(spark, sf):
    return _payments(spark, sf, "PAYMENT_PERC", "PAYMENT_DIFF")


@query("days_past_due", PAYMENTS + _select_sql("pay", KEY, ["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "DPD"]))
def days_past_due(spark, sf):
    return _payments(spark, sf, "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "DPD")


@query("days_before_due", PAYMENTS + _select_sql("pay", KEY, ["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "DBD"]))
def days_before_due(spark, sf):
    return _payments(spark, sf, "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "DBD")


@query("late_flag", PAYMENTS + _select_sql("pay", KEY, ["DPD", "LATE_PAYMENT_FLAG"]))
def late_flag(spark, sf):
    return _payments(spark, sf, "DPD", "LATE_PAYMENT_FLAG")


@query(
    "card_utilisation",
    with_sources("credit_card")
    + f", q AS (SELECT SK_ID_PREV, {sql_ratio('AMT_BALANCE', 'AMT_CREDIT_LIMIT_ACTUAL')} AS BALANCE_LIMIT_RATIO FROM credit_card) "
    + _select_sql("q", ["SK_ID_PREV"], ["BALANCE_LIMIT_RATIO"]),
)
def card_utilisation(spark, sf):
    q = P.card_utilisation(source(spark, sf, "credit_card"))
    return tidy(q.select("SK_ID_PREV", "BALANCE_LIMIT_RATIO"), digits=None)


@query(
    "age_years",
    with_sources("application") + " SELECT SK_ID_CURR, round(-DAYS_BIRTH / 365, 6) AS age_years FROM application",
)
def age_years(spark, sf):
    app = source(spark, sf, "application")
    return app.select("SK_ID_CURR", F.round(N.age_years("DAYS_BIRTH"), 6).alias("age_years"))


# ---- projection and predicates ----------------------------------------------------------


@query("drop_columns", "SELECT * EXCLUDE (l_partkey, l_suppkey, l_shipdate) FROM lineitem")
def drop_columns(spark, sf):
    return table(spark, sf, "lineitem").drop("l_partkey", "l_suppkey", "l_shipdate")


@query(
    "select_features",
    with_sources("application") + " SELECT * EXCLUDE (TARGET, SK_ID_CURR) FROM application",
)
def select_features(spark, sf):
    app = source(spark, sf, "application")
    return app.select(*feature_columns(app))


@query(
    "filter_not_sentinel",
    with_sources("application")
    + " SELECT SK_ID_CURR, CODE_GENDER FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'",
)
def filter_not_sentinel(spark, sf):
    return source(spark, sf, "application").where(N.not_sentinel("CODE_GENDER")).select("SK_ID_CURR", "CODE_GENDER")


@query(
    "filter_label_present",
    "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
)
def filter_label_present(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return labelled.where(F.col("quality").isNotNull()).select("doc_id", "quality")


@query(
    "filter_status_subset",
    with_sources("bureau")
    + """ SELECT SK_ID_CURR, count(*) AS n_credits,
  max(CASE WHEN CREDIT_ACTIVE = 'Active' THEN AMT_CREDIT_SUM END) AS active_max,
  max(CASE WHEN CREDIT_ACTIVE = 'Closed' THEN AMT_CREDIT_SUM END) AS closed_max
FROM bureau GROUP BY SK_ID_CURR""",
)
def filter_status_subset(spark, sf):
    amount, status = F.col("AMT_CREDIT_SUM"), F.col("CREDIT_ACTIVE")
    return (
        source(spark, sf, "bureau")
        .groupBy("SK_ID_CURR")
        .agg(
            F.count(F.lit(1)).alias("n_credits"),
            F.max(F.when(status == "Active", amount)).alias("active_max"),
            F.max(F.when(status == "Closed", amount)).alias("closed_max"),
        )
    )


@query(
    "sentinel_to_null",
    with_sources("previous_application")
    + " SELECT SK_ID_PREV, "
    + ", ".join(f"nullif({c}, 365243) AS {c}" for c in P.PREVIOUS_DATES)
    + " FROM previous_application",
)
def sentinel_to_null(spark, sf):
    prev = source(spark, sf, "previous_application")
    return prev.select("SK_ID_PREV", *[N.sentinel_to_null(c).alias(c) for c in P.PREVIOUS_DATES])


@query(
    "sentinel_flag",
    with_sources("application")
    + " SELECT SK_ID_CURR, CASE WHEN DAYS_EMPLOYED = 365243 THEN 1 ELSE 0 END AS DAYS_EMPLOYED_ANOM FROM application",
)
def sentinel_flag(spark, sf):
    app = source(spark, sf, "application")
    return app.select("SK_ID_CURR", N.sentinel_flag("DAYS_EMPLOYED").alias("DAYS_EMPLOYED_ANOM"))


_RATIO_ROWS = f"WITH q AS (SELECT l_orderkey, l_linenumber, {sql_ratio('l_discount', 'l_tax')} AS ratio FROM lineitem) "


def _lineitem_ratio(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", N.ratio_ieee("l_discount", "l_tax").alias("ratio"))


@query(
    "inf_to_null",
    _RATIO_ROWS + f"SELECT l_orderkey, l_linenumber, {sql_tidy('ratio', None)} AS ratio FROM q",
)
def inf_to_null(spark, sf):
    return profile.inf_to_null(_lineitem_ratio(spark, sf))


@query(
    "count_inf",
    _RATIO_ROWS + "SELECT CAST(sum(CASE WHEN isinf(ratio) THEN 1 ELSE 0 END) AS BIGINT) AS n_inf FROM q",
)
def count_inf(spark, sf):
    return profile.count_inf(_lineitem_ratio(spark, sf))


@query(
    "bool_to_int",
    """SELECT event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS is_large,
  CASE WHEN event_type = 'error' THEN NULL WHEN value < 10 THEN 1 ELSE 0 END AS is_small FROM events""",
)
def bool_to_int(spark, sf):
    events = table(spark, sf, "events")
    small = F.when(F.col("event_type") != "error", F.col("value") < 10)
    flags = events.select("event_id", (F.col("value") > 50).alias("is_large"), small.alias("is_small"))
    return profile.bool_to_int(flags)


@query(
    "prefix_rename",
    "SELECT o_custkey, min(o_totalprice) AS ORD_o_totalprice_MIN, max(o_totalprice) AS ORD_o_totalprice_MAX FROM orders GROUP BY o_custkey",
)
def prefix_rename(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy("o_custkey").agg(*spec_columns({"o_totalprice": ["min", "max"]}, "ORD_"))


@query(
    "align_schema",
    "SELECT c_acctbal, CAST(NULL AS DOUBLE) AS not_there, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer",
)
def align_schema(spark, sf):
    return scoring.align_schema(table(spark, sf, "customer"), ["c_acctbal", "not_there", "c_nationkey"])
