"""Seven source tables to one feature row per client."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import ID_COL, text_columns
from ..functions.numeric import (
    days_before_due,
    days_past_due,
    late_flag,
    not_sentinel,
    ratio_ieee,
    row_mean,
    row_std,
    sentinel_flag,
    sentinel_to_null,
)
from ..operators import encode
from ..operators.encode import Domain, dummy_tests, fit_domain, label_encode, one_hot
from ..operators.history import gathered, rollup, rollup_all_columns
from ..sources.readers import scan_limit

CREDIT_KEY = "SK_ID_BUREAU"

# Which statistics each history contributes.
BALANCE_SPEC = {"MONTHS_BALANCE": ["min", "max", "size"]}
BUREAU_SPEC = {
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean"],
    "DAYS_CREDIT_UPDATE": ["mean"],
    "CREDIT_DAY_OVERDUE": ["max", "mean"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum"],
    "DEBT_PERCENTAGE": ["mean", "max"],
    "OVERDUE_PERCENTAGE": ["mean", "max"],
    "AMT_ANNUITY": ["max", "mean"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
PREVIOUS_SPEC = {
    "AMT_ANNUITY": ["min", "max", "mean"],
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "CREDIT_APP_PERC": ["min", "max", "mean", "var"],
    "AMT_DOWN_PAYMENT": ["min", "max", "mean"],
    "AMT_GOODS_PRICE": ["min", "max", "mean"],
    "HOUR_APPR_PROCESS_START": ["min", "max", "mean"],
    "RATE_DOWN_PAYMENT": ["min", "max", "mean"],
    "DAYS_DECISION": ["min", "max", "mean"],
    "CNT_PAYMENT": ["mean", "sum"],
    "DOWN_PAYMENT_CREDIT_RATIO": ["min", "max", "mean"],
}
POS_SPEC = {
    "MONTHS_BALANCE": ["max", "mean", "size"],
    "SK_DPD": ["max", "mean"],
    "SK_DPD_DEF": ["max", "mean"],
}
INSTALLMENT_SPEC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "LATE_PAYMENT_FLAG": ["mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
BINARY_LABELS = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
PREVIOUS_DATES = [
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
]


def _fit(df: DataFrame, domain: Domain | None, skip: tuple[str, ...] = ()) -> Domain:
    return fit_domain(df, [c for c in text_columns(df) if c not in skip]) if domain is None else domain


def application_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "DAYS_EMPLOYED_PERC": ratio_ieee("DAYS_EMPLOYED", "DAYS_BIRTH"),
            "INCOME_CREDIT_PERC": ratio_ieee("AMT_INCOME_TOTAL", "AMT_CREDIT"),
            "INCOME_PER_PERSON": ratio_ieee("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
            "ANNUITY_INCOME_PERC": ratio_ieee("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
            "PAYMENT_RATE": ratio_ieee("AMT_ANNUITY", "AMT_CREDIT"),
        }
    )


def external_scores(df: DataFrame) -> DataFrame:
    names = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
    return df.withColumns({"EXT_SOURCE_MEAN": row_mean(*names), "EXT_SOURCE_STD": row_std(*names)})


def application_features(
    application: DataFrame, domain: Domain | None = None, labels: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per client of the application table, invalid genders removed."""
    valid = application.where(not_sentinel("CODE_GENDER"))
    domain = _fit(valid, domain, tuple(BINARY_LABELS))
    encoded = one_hot(label_encode(valid, BINARY_LABELS, ID_COL, labels), domain, dummy_na=False)
    flagged = encoded.withColumn("DAYS_EMPLOYED_ANOM", sentinel_flag("DAYS_EMPLOYED"))
    cleared = flagged.withColumn("DAYS_EMPLOYED", sentinel_to_null("DAYS_EMPLOYED"))
    return external_scores(application_ratios(cleared))


def balance_by_credit(balance: DataFrame, domain: Domain | None = None) -> DataFrame:
    """Monthly balances rolled up to one row per credit."""
    return rollup(balance, CREDIT_KEY, BALANCE_SPEC, _fit(balance, domain))


def bureau_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "DEBT_PERCENTAGE": ratio_ieee("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"),
            "OVERDUE_PERCENTAGE": ratio_ieee("AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM"),
        }
    )


def bureau_with_balance(bureau: DataFrame, balance: DataFrame, balance_domain: Domain | None = None) -> DataFrame:
    """Each credit with the summary of its months; NULL where a credit has none."""
    joined = bureau.join(balance_by_credit(balance, balance_domain), CREDIT_KEY, "left")
    return bureau_ratios(gathered(joined.drop(CREDIT_KEY), ID_COL))


def bureau_features(
    bureau: DataFrame,
    balance: DataFrame,
    domain: Domain | None = None,
    balance_domain: Domain | None = None,
) -> DataFrame:
    """Two-level credit history per client, plus active and closed credits on their own."""
    domain, balance_domain = _fit(bureau, domain), _fit(balance, balance_domain)
    month_shares = {f"{n}_MEAN": ["mean"] for n in dummy_tests(balance_domain, dummy_na=True)}
    credits = bureau_with_balance(bureau, balance, balance_domain)
    subsets = {
        "ACTIVE_": "CREDIT_ACTIVE <=> 'Active'",
        "CLOSED_": "CREDIT_ACTIVE <=> 'Closed'",
    }
    return rollup(credits, ID_COL, BUREAU_SPEC, domain, "BURO_", subsets, extra=month_shares)


def previous_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "CREDIT_APP_PERC": ratio_ieee("AMT_CREDIT", "AMT_APPLICATION"),
            "DOWN_PAYMENT_CREDIT_RATIO": ratio_ieee("AMT_DOWN_PAYMENT", "AMT_CREDIT"),
        }
    )


def previous_features(previous: DataFrame, domain: Domain | None = None) -> DataFrame:
    """Earlier applications per client, plus approved and refused ones on their own."""
    domain = _fit(previous, domain)
    cleared = previous.withColumns({c: sentinel_to_null(c) for c in PREVIOUS_DATES if c in previous.columns})
    subsets = {
        "APPROVED_": "NAME_CONTRACT_STATUS <=> 'Approved'",
        "REFUSED_": "NAME_CONTRACT_STATUS <=> 'Refused'",
    }
    return rollup(previous_ratios(cleared), ID_COL, PREVIOUS_SPEC, domain, "PREV_", subsets)


def pos_features(pos: DataFrame, domain: Domain | None = None) -> DataFrame:
    return rollup(pos, ID_COL, POS_SPEC, _fit(pos, domain), "POS_", count_as="POS_COUNT")


def payment_columns(df: DataFrame) -> DataFrame:
    derived = df.withColumns(
        {
            "PAYMENT_PERC": ratio_ieee("AMT_PAYMENT", "AMT_INSTALMENT"),
            "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
            "DPD": days_past_due("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT"),
            "DBD": days_before_due("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT"),
        }
    )
    return derived.withColumn("LATE_PAYMENT_FLAG", late_flag("DPD"))


def installment_features(payments: DataFrame, domain: Domain | None = None) -> DataFrame:
    domain = _fit(payments, domain)
    return rollup(payment_columns(gathered(payments, ID_COL)), ID_COL, INSTALLMENT_SPEC, domain, "INSTAL_", count_as="INSTAL_COUNT")


def card_utilisation(df: DataFrame) -> DataFrame:
    return df.withColumn("BALANCE_LIMIT_RATIO", ratio_ieee("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"))


def card_features(cards: DataFrame, domain: Domain | None = None) -> DataFrame:
    domain = _fit(cards, domain)
    return rollup_all_columns(card_utilisation(cards.drop("SK_ID_PREV")), ID_COL, domain, "CC_", "CC_COUNT")


def join_feature_blocks(base: DataFrame, *blocks: DataFrame, key: str = ID_COL) -> DataFrame:
    """Left joins on one unique key; the aggregated blocks arrive partitioned by it."""
    joined = base
    for block in blocks:
        joined = joined.join(block, key, "left")
    return joined


SOURCES = (
    "application",
    "bureau",
    "bureau_balance",
    "previous_application",
    "pos_cash",
    "installments",
    "credit_card",
)


def fit_domains(sources: Mapping[str, DataFrame]) -> dict[str, Domain]:
    """Category values of every source, from one job."""
    columns = {name: [c for c in text_columns(df) if c not in BINARY_LABELS] for name, df in sources.items()}
    return encode.fit_domains(sources, columns)


def limit_sources(sources: Mapping[str, DataFrame], num_rows: int, keys: Mapping[str, list[str]]) -> dict[str, DataFrame]:
    """The first ``num_rows`` of each source on its own, along the given sort keys."""
    return {name: scan_limit(df, num_rows, keys[name]) for name, df in sources.items()}


def build_dataset(
    sources: Mapping[str, DataFrame], domains: Mapping[str, Domain] | None = None
) -> DataFrame:
    """One row per client: the application block and the five history blocks."""
    d = fit_domains(sources) if domains is None else domains
    return join_feature_blocks(
        application_features(sources["application"], d["application"]),
        bureau_features(sources["bureau"], sources["bureau_balance"], d["bureau"], d["bureau_balance"]),
        previous_features(sources["previous_application"], d["previous_application"]),
        pos_features(sources["pos_cash"], d["pos_cash"]),
        installment_features(sources["installments"], d["installments"]),
        card_features(sources["credit_card"], d["credit_card"]),
    )
