"""Helpers shared by the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.functions.text import SPACE_BODY, SPACE_CHARS

Query = Callable[[SparkSession, str], DataFrame]

# SQL fragments.  The class body is valid in RE2 as it stands.
SP = f"[{SPACE_BODY}]"
SP_LITERAL = "'" + SPACE_CHARS + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_trim(expr: str) -> str:
    return f"trim({expr}, {SP_LITERAL})"


def sql_count(expr: str, body: str) -> str:
    return f"CAST(length(regexp_replace({expr}, '[^{body}]+', '', 'g')) AS BIGINT)"


def sql_utf16(expr: str) -> str:
    return f"(CAST(length({expr}) AS BIGINT) + {sql_count(expr, chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}')})"
