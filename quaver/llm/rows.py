"""Rows under column names of our own, so that no column of the input can clash with a working one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .workspace import materialize


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """The name that ``numbered`` gives to a column of ``df``."""
    return f"c{df.columns.index(name)}"


def named(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that ``numbered`` has made of ``like``, under their own names; all others go."""
    return df.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)))


def ranked(df: DataFrame, by: str, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``, from 0 in the order of ``by``: sorted by ranges, numbered from the ranges' counts, so no task sorts the whole table.

    Rows of one value of ``by`` take consecutive ranks in no particular order; give a column without repeats where the ranks must be the same in every run.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("__id", F.monotonically_increasing_id())
    ranged = materialize(ranged, name).withColumn("__part", F.shiftright("__id", 33))
    sums = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")  # a row for each range
    ranged = ranged.join(F.broadcast(sums.select("__part", ahead.alias("__before"))), "__part")
    return ranged.withColumn("rank", F.col("__before") + F.col("__id") - F.shiftleft("__part", 33)).drop("__part", "__id", "__before")
