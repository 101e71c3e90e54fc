"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.shared import Tables, checkpointed, fresh_path, scratch, shared_dir, written

__all__ = ["Tables", "checkpointed", "fresh_path", "let", "scratch", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a column that a lambda refers to may be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
