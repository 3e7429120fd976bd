"""Explicit schemas of the sources. None of them is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Columns the features are computed from; a source may hold more.
APPLICATION = _struct(
    SK_ID_CURR=_LONG,
    TARGET=_INT,
    CODE_GENDER=_TEXT,
    FLAG_OWN_CAR=_TEXT,
    FLAG_OWN_REALTY=_TEXT,
    NAME_CONTRACT_TYPE=_TEXT,
    DAYS_EMPLOYED=_INT,
    DAYS_BIRTH=_INT,
    AMT_INCOME_TOTAL=_DOUBLE,
    AMT_CREDIT=_DOUBLE,
    AMT_ANNUITY=_DOUBLE,
    CNT_FAM_MEMBERS=_DOUBLE,
    EXT_SOURCE_1=_DOUBLE,
    EXT_SOURCE_2=_DOUBLE,
    EXT_SOURCE_3=_DOUBLE,
)
BUREAU = _struct(
    SK_ID_CURR=_LONG,
    SK_ID_BUREAU=_LONG,
    CREDIT_ACTIVE=_TEXT,
    CREDIT_TYPE=_TEXT,
    DAYS_CREDIT=_INT,
    DAYS_CREDIT_ENDDATE=_DOUBLE,
    DAYS_CREDIT_UPDATE=_INT,
    CREDIT_DAY_OVERDUE=_INT,
    AMT_CREDIT_MAX_OVERDUE=_DOUBLE,
    AMT_CREDIT_SUM=_DOUBLE,
    AMT_CREDIT_SUM_DEBT=_DOUBLE,
    AMT_CREDIT_SUM_OVERDUE=_DOUBLE,
    AMT_CREDIT_SUM_LIMIT=_DOUBLE,
    AMT_ANNUITY=_DOUBLE,
    CNT_CREDIT_PROLONG=_INT,
)
BUREAU_BALANCE = _struct(SK_ID_BUREAU=_LONG, MONTHS_BALANCE=_INT, STATUS=_TEXT)
PREVIOUS_APPLICATION = _struct(
    SK_ID_CURR=_LONG,
    SK_ID_PREV=_LONG,
    NAME_CONTRACT_STATUS=_TEXT,
    NAME_CONTRACT_TYPE=_TEXT,
    AMT_ANNUITY=_DOUBLE,
    AMT_APPLICATION=_DOUBLE,
    AMT_CREDIT=_DOUBLE,
    AMT_DOWN_PAYMENT=_DOUBLE,
    AMT_GOODS_PRICE=_DOUBLE,
    HOUR_APPR_PROCESS_START=_INT,
    RATE_DOWN_PAYMENT=_DOUBLE,
    DAYS_DECISION=_INT,
    CNT_PAYMENT=_DOUBLE,
    DAYS_FIRST_DRAWING=_DOUBLE,
    DAYS_FIRST_DUE=_DOUBLE,
    DAYS_LAST_DUE_1ST_VERSION=_DOUBLE,
    DAYS_LAST_DUE=_DOUBLE,
    DAYS_TERMINATION=_DOUBLE,
)
POS_CASH = _struct(
    SK_ID_CURR=_LONG, MONTHS_BALANCE=_INT, SK_DPD=_INT, SK_DPD_DEF=_INT, NAME_CONTRACT_STATUS=_TEXT
)
INSTALLMENTS = _struct(
    SK_ID_CURR=_LONG,
    NUM_INSTALMENT_VERSION=_DOUBLE,
    DAYS_INSTALMENT=_DOUBLE,
    DAYS_ENTRY_PAYMENT=_DOUBLE,
    AMT_INSTALMENT=_DOUBLE,
    AMT_PAYMENT=_DOUBLE,
)
CREDIT_CARD = _struct(
    SK_ID_CURR=_LONG,
    SK_ID_PREV=_LONG,
    MONTHS_BALANCE=_INT,
    AMT_BALANCE=_DOUBLE,
    AMT_CREDIT_LIMIT_ACTUAL=_DOUBLE,
    AMT_DRAWINGS_CURRENT=_DOUBLE,
    SK_DPD=_INT,
    NAME_CONTRACT_STATUS=_TEXT,
)

PREDICTION = _struct(client_id=_LONG, score=_DOUBLE, decision=_TEXT)
CALL_LOG = _struct(
    timestamp=T.TimestampType(),
    level=_TEXT,
    endpoint=_TEXT,
    latency_ms=_DOUBLE,
    n_requested=_LONG,
    n_scored=_LONG,
    n_not_found=_LONG,
    predictions=T.ArrayType(PREDICTION),
    not_found=T.ArrayType(_LONG),
    client_id=_LONG,
    score=_DOUBLE,
    decision=_TEXT,
    n_features=_LONG,
    message=_TEXT,
)
RUNS = T.StructType(
    [
        T.StructField("run", _TEXT),
        T.StructField("logged_at", T.TimestampType()),
        T.StructField("kind", _TEXT),
        T.StructField("key", _TEXT),
        T.StructField("value", _TEXT),
        T.StructField("tags", T.MapType(_TEXT, _TEXT)),
    ]
)

# The file each source comes from.
SOURCE_FILES = {
    "application": ("application_train.csv", APPLICATION),
    "bureau": ("bureau.csv", BUREAU),
    "bureau_balance": ("bureau_balance.csv", BUREAU_BALANCE),
    "previous_application": ("previous_application.csv", PREVIOUS_APPLICATION),
    "pos_cash": ("POS_CASH_balance.csv", POS_CASH),
    "installments": ("installments_payments.csv", INSTALLMENTS),
    "credit_card": ("credit_card_balance.csv", CREDIT_CARD),
}
