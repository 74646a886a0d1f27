"""The queries on the supplied tables, each with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarkash.plans import evaluation, evidence, filling, lexicon, menus, script, training

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return lexicon.QUERIES | evidence.QUERIES | script.QUERIES | menus.QUERIES | evaluation.QUERIES | filling.QUERIES | training.QUERIES


def oracle_sql() -> dict[str, str]:
    return lexicon.ORACLE | evidence.ORACLE | menus.ORACLE | evaluation.ORACLE | filling.ORACLE | training.ORACLE
