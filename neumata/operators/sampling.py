"""Seeded sampling, splitting, mixing and set checks; every draw is a hash of ids and seed, so it can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S


def ranked(df: DataFrame, by: str, key: str, seed) -> DataFrame:
    """df and rn: a random order within each group."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(S.hashed(F.col(key), seed), key)))


def proportional(df: DataFrame, by: str, key: str, k: int, epoch: int = 0) -> DataFrame:
    """At most k rows of each group, drawn anew each epoch."""
    return ranked(df, by, key, f"epoch{epoch}").where(F.col("rn") <= k).drop("rn")


def split(df: DataFrame, by: str, key: str, share: float = 0.02, least: int = 50, most: int = 500, seed: int = 77) -> DataFrame:
    """df and split: train or test; the test part of each group is a share of it within bounds."""
    n = F.count("*").over(Window.partitionBy(by))
    size = F.least(F.greatest(F.floor(n * share), F.lit(least)), F.lit(most))
    rows = ranked(df, by, key, seed).withColumn("size", size)
    return rows.withColumn("split", F.when(F.col("rn") <= F.col("size"), "test").otherwise("train")).drop("rn", "size")


def thinned(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """One row in n."""
    return df.where(F.pmod(S.hashed(F.col(key), seed), F.lit(n)) == 0)


def first_rows(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def placed(sizes: DataFrame, positions: DataFrame) -> DataFrame:
    """position, dataset, local: which data set of a concatenation a global position falls into, and where."""
    w = Window.orderBy("dataset")  # one row a data set
    bounds = sizes.withColumn("upto", F.sum("n").over(w)).withColumn("from", F.col("upto") - F.col("n"))
    hit = (F.col("position") >= F.col("from")) & (F.col("position") < F.col("upto"))
    return positions.join(F.broadcast(bounds), hit).select("position", "dataset", (F.col("position") - F.col("from")).alias("local"))


def is_partition(df: DataFrame, key: str, part: str) -> DataFrame:
    """rows, keys, doubles: whether parts cover all keys once."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(part).alias("parts"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("parts") > 1).alias("doubles"))
