"""One row per array element, with the array computed once.

A plain `explode` lets the optimizer add a test of the array's size below it, and that test repeats
the whole expression, even once per element where a lambda refers to it. The outer form has no such
test; the one null row of an empty array is dropped after it.
"""

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(df: DataFrame, array: Column, name: str, *keep) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, array: Column, position: str, name: str, *keep) -> DataFrame:
    """With a 1-based position."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, name)).filter(F.col(name).isNotNull())
    return rows.withColumn(position, (F.col(position) + 1).cast("bigint"))


def inline_rows(df: DataFrame, structs: Column, field: str, *keep) -> DataFrame:
    """The fields of each struct as columns; `field` is one that is never null."""
    return df.select(*keep, F.inline_outer(structs)).filter(F.col(field).isNotNull())
