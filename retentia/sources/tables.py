"""Readers for the application's source tables with declared schemas.

Chat tables come from parquet exports or straight from the database over
JDBC, split into parallel range reads on a numeric column (never one
connection for the whole table). A missing parquet table reads as empty with
its schema, like a freshly created table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..context import ensure_utc
from ..model import CONVERSATIONS_SCHEMA, LOGIN_AUDIT_SCHEMA, MESSAGES_SCHEMA


def read_parquet_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    ensure_utc(spark)
    try:
        df = spark.read.parquet(path)
    except Exception as exc:  # noqa: BLE001 - only a missing path is expected
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    schema: StructType,
    partition_column: str,
    lower: int,
    upper: int,
    num_partitions: int,
    properties: dict | None = None,
) -> DataFrame:
    """Parallel JDBC read: ``num_partitions`` range queries on ``partition_column``."""
    ensure_utc(spark)
    df = spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=num_partitions,
        properties=properties or {},
    )
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def messages(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet_or_empty(spark, path, MESSAGES_SCHEMA)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet_or_empty(spark, path, CONVERSATIONS_SCHEMA)


def login_audit(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet_or_empty(spark, path, LOGIN_AUDIT_SCHEMA)
