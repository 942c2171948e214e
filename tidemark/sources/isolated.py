"""Sources apart from each other: one that fails is empty, and says so."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.tables import materialise


def union_of(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], columns: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all sources in ``columns`` (a DDL list), and ``source, status, rows, error`` of each.

    Every source is read and written by itself, so a missing folder, a broken file or a wrong type ends that source's job alone; no
    row of it is kept then. Missing columns are null, others are left out; a column that cannot be had in its type fails the source. Errors of the
    program itself (anything but Spark's) are not caught.
    """
    schema = spark.createDataFrame([], columns).schema
    kept, status = [], []
    for name, read in sources.items():
        try:
            rows = materialise(_shaped(read(), schema))
            kept.append(rows)
            status.append((name, "completed", rows.count(), ""))
        except (PySparkException, Py4JJavaError) as error:
            what = error.getCondition() if isinstance(error, PySparkException) else None
            status.append((name, "failed", 0, what or type(error).__name__))
    return reduce(DataFrame.unionByName, kept, spark.createDataFrame([], schema)), spark.createDataFrame(status, "source string, status string, rows long, error string")


def _shaped(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
