"""Readers. Every schema is given, so no file is opened just to guess one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import ID_COL
from ..operators.ordered import first_rows
from ..schemas import CALL_LOG, SOURCE_FILES


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header line; its columns are matched to the schema by name.

    Empty fields are NULL. Columns outside the schema are not parsed.
    """
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in schema.fields}
    missing = [c for c in known if c not in header]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    layout = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    raw = spark.read.schema(layout).option("header", True).option("nullValue", "").csv(path)
    return raw.select(*known)


def scan_limit(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The first ``n`` rows along ``keys``, which make the choice repeatable."""
    return first_rows(df, list(keys), n)


def scan_parquet(
    spark: SparkSession, path: str, csv_path: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """A Parquet table; where it does not exist, the CSV of the same content."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND" or csv_path is None or schema is None:
            raise
    return scan_csv(spark, csv_path, schema)


def loan_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven loan tables of a folder of CSV files."""
    return {name: scan_csv(spark, f"{folder}/{file}", schema) for name, (file, schema) in SOURCE_FILES.items()}


def point_lookup(spark: SparkSession, path: str, key_value: int, key: str = ID_COL) -> DataFrame:
    """One client's row of a table written by ``sink_table``.

    The table is sorted by key, so the pushed filter skips all row groups but one.
    """
    return spark.read.parquet(path).where(F.col(key) == F.lit(key_value))


def log_source_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed log records from text lines, batch or stream.

    A line that is not a JSON object keeps its text in ``message``.
    """
    spare = "_corrupt_record"
    schema = T.StructType([*CALL_LOG.fields, T.StructField(spare, T.StringType())])
    parsed = lines.select(F.from_json(column, schema, {"columnNameOfCorruptRecord": spare}).alias("j"))
    names = [f.name for f in CALL_LOG.fields if f.name != "message"]
    return parsed.select(
        *[F.col(f"j.{n}").alias(n) for n in names],
        F.coalesce(f"j.{spare}", "j.message").alias("message"),
        F.col(f"j.{spare}").isNotNull().alias("is_text"),
    )
