"""Governed SQL: given SELECT statements over the registered relations."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions.text import strip
from txnlens.plans.statements import check_statement
from txnlens.schemas import RELATIONS

# Statement words refused anywhere in a text, trailing blank included.
DENIED = ("insert ", "update ", "delete ", "drop ", "create ", "alter ", "truncate ")


def cleaned_sql(sql: Column) -> Column:
    """The statement without surrounding white space and without closing semicolons."""
    return F.rtrim(strip(sql), F.lit(";"))


def sql_denied(sql: Column) -> Column:
    """True where a statement holds a denied word."""
    lowered = F.lower(cleaned_sql(sql))
    found = F.lit(False)
    for word in DENIED:
        found = found | lowered.contains(word)
    return found


def checked_sql(sql: str) -> str:
    """The statement to run; raises if it holds a denied word."""
    text = sql.strip().rstrip(";")
    lowered = text.lower()
    if any(word in lowered for word in DENIED):
        raise ValueError("statement holds a denied word")
    return text


def run_select(
    spark: SparkSession, sql: str, limit: int | None = None, strict: bool = False, relations: Collection[str] | None = None
) -> DataFrame:
    """Run a given statement (Spark SQL dialect) and return its result, whole unless ``limit`` is set.

    ``strict`` judges the parsed statement instead of its words alone, see ``check_statement``: it
    must be a query over the views of ``relations`` (those of the star and its aggregates if not
    given) and its own common tables; files, table functions and calls into Java are refused.
    """
    text = checked_sql(sql)
    if strict:
        check_statement(spark, text, RELATIONS if relations is None else relations)
    result = spark.sql(text)
    return result if limit is None else result.limit(limit)
