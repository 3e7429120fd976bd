"""Scans, column profiles, correlation, selection, splits, ordering and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import correlate, profile, reshape, splits
from ..session import scratch_path
from ..sources import readers, sinks
from .bindings import source, with_sources
from .registry import query, table, tidy

# ---- sources and sinks ------------------------------------------------------------------


@query("scan_csv", "SELECT * FROM customer")
def scan_csv(spark, sf):
    customers = table(spark, sf, "customer")
    path = scratch_path(spark, "customer-csv")
    customers.write.option("header", True).csv(path)
    return readers.scan_csv(spark, path, customers.schema)


@query("scan_limit", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def scan_limit(spark, sf):
    return readers.scan_limit(table(spark, sf, "orders"), 1000, ["o_orderkey"])


@query("scan_parquet", "SELECT * FROM supplier")
def scan_parquet(spark, sf):
    return readers.scan_parquet(spark, f"{sf}/supplier.parquet")


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 777")
def point_lookup(spark, sf):
    path = scratch_path(spark, "orders-by-key")
    sinks.sink_table(table(spark, sf, "orders"), path, "o_orderkey")
    return readers.point_lookup(spark, path, 777, "o_orderkey")


@query("sink_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def sink_table(spark, sf):
    path = scratch_path(spark, "orders-table")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    sinks.sink_table(orders, path, "o_orderkey")
    return spark.read.parquet(path)


# ---- profiles ---------------------------------------------------------------------------

# A table with missing, constant, nearly constant and boolean-like columns.
_MESSY_SQL = """WITH messy AS (
  SELECT l_orderkey, l_quantity, l_returnflag,
    nullif(l_tax, 0) AS tax, CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN l_discount END AS rare,
    CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN 0 ELSE 1 END AS nearly_one,
    CASE WHEN l_quantity > 0 THEN 'same' END AS same_text, CAST(NULL AS DOUBLE) AS empty,
    CASE WHEN l_discount > 0.05::DOUBLE THEN 1 ELSE 0 END AS TARGET,
    CASE WHEN l_quantity = 50 AND l_linenumber = 1 AND l_discount > 0.05::DOUBLE THEN 1
         WHEN l_quantity = 50 AND l_linenumber = 1 THEN 0 END AS leak
  FROM lineitem)
"""


def _messy(spark, sf):
    li = table(spark, sf, "lineitem")
    rare = (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 1)
    high = (F.col("l_discount") > F.lit(0.05)).cast("int")
    return li.select(
        "l_orderkey",
        "l_quantity",
        "l_returnflag",
        N.sentinel_to_null("l_tax", 0.0).alias("tax"),
        F.when(rare, F.col("l_discount")).alias("rare"),
        F.when(rare, 0).otherwise(1).alias("nearly_one"),
        F.when(F.col("l_quantity") > 0, "same").alias("same_text"),
        F.lit(None).cast("double").alias("empty"),
        high.alias("TARGET"),
        F.when(rare, high).alias("leak"),
    )


_MESSY_COLUMNS = [
    "l_orderkey", "l_quantity", "l_returnflag", "tax", "rare", "nearly_one", "same_text", "empty", "TARGET", "leak",
]


def _per_column(expr: str, value: str, columns=_MESSY_COLUMNS) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {expr.format(c=c)} AS {value} FROM messy" for c in columns
    )


_NULL_RATIO = _per_column("avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END)", "null_ratio")


@query("null_ratio", _MESSY_SQL + f'SELECT "column", round(null_ratio, 6) AS null_ratio FROM ({_NULL_RATIO}) q')
def null_ratio(spark, sf):
    return tidy(profile.null_ratio(_messy(spark, sf)), digits=6)


@query(
    "null_count_total",
    _MESSY_SQL
    + "SELECT CAST(sum(n) AS BIGINT) AS n_null FROM ("
    + _per_column("count(*) - count({c})", "n")
    + ") q",
)
def null_count_total(spark, sf):
    return profile.null_count_total(_messy(spark, sf))


@query("nonnull_count", _MESSY_SQL + _per_column("count({c})", "n_known"))
def nonnull_count(spark, sf):
    return profile.nonnull_count(_messy(spark, sf))


@query(
    "select_high_missing",
    _MESSY_SQL + f'SELECT "column", round(null_ratio, 6) AS null_ratio FROM ({_NULL_RATIO}) q WHERE null_ratio > 0.99',
)
def select_high_missing(spark, sf):
    return tidy(profile.select_high_missing(_messy(spark, sf)), digits=6)


def sql_corr(x: str, y: str) -> str:
    """Pairwise-complete Pearson in SQL, NULL for a constant side."""
    a = f"CASE WHEN {y} IS NOT NULL THEN CAST({x} AS DOUBLE) END"
    b = f"CASE WHEN {x} IS NOT NULL THEN CAST({y} AS DOUBLE) END"
    return f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END"


_MESSY_NUMBERS = ["l_orderkey", "l_quantity", "tax", "rare", "nearly_one", "empty", "leak"]
_MESSY_R = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql_corr(c, 'TARGET')} AS r FROM messy" for c in _MESSY_NUMBERS
)


@query("target_corr", _MESSY_SQL + f'SELECT "column", round(r, 6) AS r FROM ({_MESSY_R}) q')
def target_corr(spark, sf):
    return tidy(profile.target_corr(_messy(spark, sf), "TARGET"), digits=6)


@query(
    "suspicious_missing",
    _MESSY_SQL
    + f', nr AS ({_NULL_RATIO}), tc AS ({_MESSY_R}) SELECT "column", round(null_ratio, 6) AS null_ratio, round(r, 6) AS r '
    + 'FROM nr JOIN tc USING ("column") WHERE null_ratio > 0.99 AND abs(r) > 0.8',
)
def suspicious_missing(spark, sf):
    return tidy(profile.suspicious_missing(_messy(spark, sf), "TARGET"), digits=6)


@query(
    "constant_columns",
    _MESSY_SQL
    + 'SELECT "column" FROM ('
    + _per_column("count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)", "n")
    + ") q WHERE n <= 1",
)
def constant_columns(spark, sf):
    return profile.constant_columns(_messy(spark, sf))


_TOP_SHARE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", max(n) / sum(n) AS top_share FROM (SELECT count(*) AS n FROM messy GROUP BY {c})"
    for c in _MESSY_COLUMNS
)


@query(
    "quasi_constant_columns",
    _MESSY_SQL + f'SELECT "column", round(CAST(top_share AS DOUBLE), 6) AS top_share FROM ({_TOP_SHARE}) q WHERE top_share > 0.99',
)
def quasi_constant_columns(spark, sf):
    return tidy(profile.quasi_constant_columns(_messy(spark, sf)), digits=6)


@query(
    "distinct_values",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, row_number() OVER (ORDER BY {c} NULLS FIRST) AS rank "
        f"FROM (SELECT DISTINCT {c} FROM part)) WHERE rank <= 20"
        for c in ["p_name", "p_brand", "p_type"]
    ),
)
def distinct_values(spark, sf):
    return profile.distinct_values(table(spark, sf, "part"))


@query(
    "value_counts_norm",
    with_sources("application")
    + """ SELECT TARGET, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM application) AS DOUBLE), 6) AS share
FROM application WHERE TARGET IS NOT NULL GROUP BY TARGET""",
)
def value_counts_norm(spark, sf):
    return tidy(profile.value_counts_norm(source(spark, sf, "application"), "TARGET"), digits=6)


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  min({c}) AS min, max({c}) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75 FROM d"""
    for c in ["l_quantity", "l_tax", "days"]
)


@query(
    "describe",
    "WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, nullif(l_tax, 0) AS l_tax, "
    "CAST(day(l_shipdate) AS DOUBLE) AS days FROM lineitem) " + _DESCRIBE,
)
def describe(spark, sf):
    li = table(spark, sf, "lineitem")
    d = li.select("l_quantity", N.sentinel_to_null("l_tax", 0.0).alias("l_tax"), F.dayofmonth("l_shipdate").alias("days"))
    return tidy(profile.describe(d))


@query(
    "default_rate",
    with_sources("application")
    + """ SELECT NAME_CONTRACT_TYPE, round(avg(TARGET), 6) AS default_rate, CAST(sum(TARGET) AS BIGINT) AS n_default,
  count(*) AS n_rows FROM application GROUP BY NAME_CONTRACT_TYPE""",
)
def default_rate(spark, sf):
    return tidy(profile.default_rate(source(spark, sf, "application"), "TARGET", "NAME_CONTRACT_TYPE"), digits=6)


@query(
    "shape_report",
    _MESSY_SQL
    + f"SELECT (SELECT count(*) FROM messy) AS n_rows, {len(_MESSY_COLUMNS)} AS n_columns, CAST(sum(n) AS BIGINT) AS n_null FROM ("
    + _per_column("count(*) - count({c})", "n")
    + ") q",
)
def shape_report(spark, sf):
    return profile.shape_report(_messy(spark, sf))


# ---- correlation and selection ----------------------------------------------------------

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "tax", "paid", "flat"]
_NUMBERS_SQL = """WITH x AS (
  SELECT l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0) AS tax,
    l_extendedprice * (1 - l_discount) AS paid, CAST(7 AS DOUBLE) AS flat,
    CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS TARGET FROM lineitem)
"""


def _numbers(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        N.sentinel_to_null("l_tax", 0.0).alias("tax"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"),
        F.lit(7.0).alias("flat"),
        (F.col("l_quantity") > 45).cast("int").alias("TARGET"),
    )


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS column_i, '{b}' AS column_j, {i} AS i, {j} AS j, {sql_corr(a, b)} AS r FROM x"
    for i, a in enumerate([*_NUMBERS, "TARGET"])
    for j, b in enumerate([*_NUMBERS, "TARGET"])
    if i < j
)
_TARGET_R = (
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {sql_corr(c, 'TARGET')} AS r FROM x" for c in _NUMBERS)
    + " UNION ALL SELECT 'TARGET', 1.0::DOUBLE"
)


@query("corr_matrix", _NUMBERS_SQL + f"SELECT column_i, column_j, round(r, 6) AS r FROM ({_PAIRS}) q")
def corr_matrix(spark, sf):
    return tidy(correlate.corr_pairs(_numbers(spark, sf)).select("column_i", "column_j", "r"), digits=6)


@query(
    "corr_matrix_embeddings",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
SELECT a.k AS i, b.k AS j, round(corr(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)), 6) AS r
FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY a.k, b.k""",
)
def corr_matrix_embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    wide = e.select(*[F.col("embedding")[k].alias(f"e{k}") for k in range(64)])
    pairs = correlate.corr_pairs(wide)
    return tidy(pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "r"), digits=6)


@query(
    "high_corr_columns",
    _NUMBERS_SQL + f'SELECT DISTINCT column_j AS "column" FROM ({_PAIRS}) q WHERE abs(r) > 0.9',
)
def high_corr_columns(spark, sf):
    return correlate.high_corr_columns(correlate.corr_pairs(_numbers(spark, sf)))


@query(
    "corr_prune",
    _NUMBERS_SQL
    + f""", p AS ({_PAIRS}), t AS ({_TARGET_R})
SELECT DISTINCT CASE WHEN abs(tj.r) < abs(ti.r) THEN p.column_j ELSE p.column_i END AS "column"
FROM p LEFT JOIN t ti ON p.column_i = ti."column" LEFT JOIN t tj ON p.column_j = tj."column" WHERE abs(p.r) > 0.9""",
)
def corr_prune(spark, sf):
    return correlate.prune_correlated(_numbers(spark, sf), "TARGET")


@query(
    "top_corr_features",
    _NUMBERS_SQL
    + f'SELECT "column", round(r, 6) AS r FROM ({_TARGET_R}) q WHERE r IS NOT NULL AND "column" <> \'TARGET\' '
    + 'ORDER BY abs(r) DESC, "column" LIMIT 4',
)
def top_corr_features(spark, sf):
    return tidy(correlate.top_corr_features(profile.target_corr(_numbers(spark, sf), "TARGET"), 4), digits=6)


@query(
    "top_bottom",
    _NUMBERS_SQL
    + f""", t AS (SELECT * FROM ({_TARGET_R}) q WHERE r IS NOT NULL AND "column" <> 'TARGET')
(SELECT "column", round(r, 6) AS r, 'low' AS "end" FROM t ORDER BY r, "column" LIMIT 2)
UNION ALL (SELECT "column", round(r, 6) AS r, 'high' AS "end" FROM t ORDER BY r DESC, "column" DESC LIMIT 2)""",
)
def top_bottom(spark, sf):
    return tidy(correlate.top_bottom(profile.target_corr(_numbers(spark, sf), "TARGET"), 2), digits=6)


# ---- splits and samples -----------------------------------------------------------------

_HASHED = with_sources("application") + """,
h AS (SELECT SK_ID_CURR, TARGET, md5(CAST(SK_ID_CURR AS VARCHAR) || '-42') AS h FROM application),
r AS (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY h, SK_ID_CURR) AS rank FROM h),
c AS (SELECT TARGET, count(*) AS n, (SELECT count(*) FROM h) AS total FROM h GROUP BY TARGET)
"""


def _quota_sql(n_train: str) -> str:
    return f""", e AS (SELECT TARGET, n, ({n_train}) * n // total AS base, ({n_train}) * n % total AS rest, {n_train} AS n_train FROM c),
q AS (SELECT TARGET, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, TARGET)
  <= n_train - (SELECT sum(base) FROM e) THEN 1 ELSE 0 END AS quota FROM e)
"""


@query(
    "split_stratified",
    _HASHED
    + _quota_sql("total - (total + 4) // 5")
    + "SELECT SK_ID_CURR, r.TARGET, CASE WHEN rank <= quota THEN 'train' ELSE 'test' END AS split FROM r JOIN q ON r.TARGET = q.TARGET",
)
def split_stratified(spark, sf):
    app = source(spark, sf, "application").select("SK_ID_CURR", "TARGET")
    return splits.split_stratified(app, "SK_ID_CURR", "TARGET")


@query(
    "sample_fraction",
    _HASHED
    + _quota_sql("total // 5")
    + "SELECT SK_ID_CURR, r.TARGET FROM r JOIN q ON r.TARGET = q.TARGET WHERE rank <= quota",
)
def sample_fraction(spark, sf):
    app = source(spark, sf, "application").select("SK_ID_CURR", "TARGET")
    return splits.sample_fraction(app, "SK_ID_CURR", "TARGET", 0.2)


@query(
    "kfold_stratified",
    _HASHED
    + """, s AS (SELECT TARGET, n, coalesce(sum(n) OVER (ORDER BY TARGET ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
f AS (SELECT TARGET, f.range AS fold, (n - ((f.range - start) % 5 + 5) % 5 + 4) // 5 AS size FROM s, range(5) f),
u AS (SELECT TARGET, fold, sum(size) OVER (PARTITION BY TARGET ORDER BY fold) AS upto,
  sum(size) OVER (PARTITION BY TARGET ORDER BY fold) - size AS before FROM f)
SELECT SK_ID_CURR, r.TARGET, CAST(fold AS INT) AS fold FROM r JOIN u ON r.TARGET = u.TARGET AND rank > before AND rank <= upto""",
)
def kfold_stratified(spark, sf):
    app = source(spark, sf, "application").select("SK_ID_CURR", "TARGET")
    return splits.kfold_stratified(app, "SK_ID_CURR", "TARGET")


@query(
    "split_by_key_order",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rank, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, CASE WHEN rank <= CAST(floor(total * 0.8) AS BIGINT) THEN 'reference' ELSE 'current' END AS slice FROM n""",
)
def split_by_key_order(spark, sf):
    return splits.split_by_key_order(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("sample_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '-42'), o_orderkey LIMIT 5000")
def sample_n(spark, sf):
    return splits.sample_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query(
    "dropna_rows",
    with_sources("application")
    + """ SELECT SK_ID_CURR, EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3 FROM application WHERE EXT_SOURCE_1 IS NOT NULL
  AND EXT_SOURCE_2 IS NOT NULL AND EXT_SOURCE_3 IS NOT NULL AND DAYS_BIRTH IS NOT NULL AND TARGET IS NOT NULL""",
)
def dropna_rows(spark, sf):
    app = source(spark, sf, "application")
    whole = splits.dropna_rows(app, ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3", "DAYS_BIRTH", "TARGET"])
    return whole.select("SK_ID_CURR", "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3")


# ---- order and shape --------------------------------------------------------------------


@query("sort_by_key", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey")
def sort_by_key(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")


@query(
    "latest_n",
    "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def latest_n(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return reshape.latest_n(events, "ts", "event_id")


@query(
    "union_slices",
    "SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier",
)
def union_slices(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))
    return reshape.union_slices({"customer": c, "supplier": s}, "source")


@query(
    "intersect_columns",
    _MESSY_SQL
    + f'SELECT "column" FROM ({_NULL_RATIO}) a WHERE null_ratio > 0.5 INTERSECT SELECT "column" FROM ({_MESSY_R}) b WHERE r IS NOT NULL',
)
def intersect_columns(spark, sf):
    messy = _messy(spark, sf)
    empty = profile.null_ratio(messy).where(F.col("null_ratio") > 0.5)
    related = profile.target_corr(messy, "TARGET").where(F.col("r").isNotNull())
    return reshape.intersect_columns(empty, related)


@query(
    "concat_columns",
    """SELECT o.o_orderkey, o.o_totalprice, l.n_lines FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey""",
)
def concat_columns(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return reshape.concat_columns(orders, lines, key="o_orderkey")


@query(
    "wide_to_long",
    " UNION ALL ".join(
        f"SELECT event_id, '{n}' AS feature, {x} AS value FROM events"
        for n, x in [("value", "value"), ("hour", "CAST(hour(ts) AS DOUBLE)"), ("day", "CAST(day(ts) AS DOUBLE)")]
    ),
)
def wide_to_long(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"))
    return reshape.wide_to_long(events, ["event_id"], ["value", "hour", "day"])
