"""Tables that a plan writes on its way, in the folder that all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below the session's ``spark.checkpoint.dir``; only a local session without it gets one below its warehouse."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{root}/{name}-{uuid4().hex}"


def dealt(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` written once with a folder for each value of ``column``, so that a filter on it reads that folder only."""
    path = scratch(rows.sparkSession, name)
    rows.write.partitionBy(column).parquet(path)
    return rows.sparkSession.read.schema(rows.select(*[c for c in rows.columns if c != column], column).schema).parquet(path)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read again: what several branches of a plan use is computed once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
