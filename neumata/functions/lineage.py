"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a session on one machine may name none: it gets a temporary one."""
    conf = spark.sparkContext.getConf()
    if not (named := conf.get("spark.checkpoint.dir")) and not re.match(r"local(\[|$)", conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="neumata-")


def cut(df: DataFrame) -> DataFrame:
    """df, written with a reliable checkpoint to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a table that may be broadcast.
MOST_ROWS = 100_000


def bounded_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows and what table (a row a key) says of their key: a small table is broadcast, its rows counted first; otherwise both are shuffled."""
    table = cut(table)
    return rows.join(F.broadcast(table) if table.count() <= MOST_ROWS else table, key)
