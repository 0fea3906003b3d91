"""Comparisons that possibly hold between cells that are constants or variables, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a cell is a variable if it starts with an ASCII letter.
VARIABLE = "^[a-zA-Z]"
_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
OPS = tuple(_COMPARE)
_SAME = {"=": "==", "<>": "!="}


def operator(op: str) -> str:
    op = _SAME.get(op, op)
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return op


def is_var(c: Column) -> Column:
    """Whether a cell is a variable; false for null."""
    return F.coalesce(c.rlike(VARIABLE), F.lit(False))


def possibly(op: str, a: Column, b: Column) -> Column:
    """Whether a op b holds in some world: it does for two constants, or either is a variable; false where a null decides."""
    return F.coalesce(_COMPARE[operator(op)](a, b), F.lit(False)) | is_var(a) | is_var(b)


# The SQL names of the comparisons.
SQL_NAMES = {"equal": "==", "not_equal": "!=", "geq": ">=", "leq": "<=", "greater": ">", "less": "<"}


def register(spark: SparkSession) -> None:
    """is_var, the six comparisons and hops as SQL functions, which Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_var(a STRING) RETURNS BOOLEAN RETURN coalesce(rlike(a, '{VARIABLE}'), false)")
    for name, op in SQL_NAMES.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a STRING, b STRING) RETURNS BOOLEAN "
            f"RETURN coalesce(a {op} b, false) OR coalesce(rlike(a, '{VARIABLE}'), false) OR coalesce(rlike(b, '{VARIABLE}'), false)"
        )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hops(p STRING) RETURNS INT RETURN CASE WHEN p = '_' THEN 0 ELSE size(split(p, ' ')) END")
