"""Registration of the package's Python functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import payload

FUNCTIONS = {"interpolate_positional": payload.interpolate_positional, "interpolate_named": payload.interpolate_named}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL; their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    return sorted(FUNCTIONS)
