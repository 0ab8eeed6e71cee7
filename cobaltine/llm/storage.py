"""Where lineage is cut: checkpoints in the folder that all executors share; and how tables meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ids (8 bytes each) that are broadcast rather than met in a shuffle
MOST_BROADCAST = 4_000_000


def shared_folder(session: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local session that has none gets
    one, below its warehouse; a cluster without the setting is an error.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = session.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared checkpoint folder and returns a frame that reads it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def anew(grouped: DataFrame, key: str) -> DataFrame:
    """``grouped``, a table grouped by the number ``key``, with that column computed again.

    A join on it then shuffles both sides.  Else the grouping deals out the join too, and
    Spark cannot split a partition in which the other side has one key very often.
    """
    return grouped.withColumn(key, F.col(key) + F.lit(0))


def broadcast_if_small(ids: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``ids`` written to the checkpoint folder, and marked for a broadcast if they are ``most`` rows or fewer."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= most else ids
