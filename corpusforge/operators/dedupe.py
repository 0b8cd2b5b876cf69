"""Exact duplicates by normalised key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collapse(atoms: DataFrame) -> DataFrame:
    """atoms (id, skill, source_order, norm_key) with survivor: the id of the first of its key by skill, order and id.

    The first is a minimum over structs, summed up before the shuffle, and joined back: a key that very many atoms share
    is never gathered in one task.
    """
    first = atoms.groupBy("norm_key").agg(F.min(F.struct("skill", "source_order", "id")).alias("first")).select(F.col("norm_key").alias("first_key"), F.col("first.id").alias("survivor"))
    return atoms.join(first, F.col("norm_key").eqNullSafe(F.col("first_key"))).drop("first_key")


def survivors(collapsed: DataFrame) -> DataFrame:
    return collapsed.filter(F.col("id") == F.col("survivor"))


def collapsed_map(collapsed: DataFrame) -> DataFrame:
    return collapsed.filter(F.col("id") != F.col("survivor")).select("id", "survivor")


def order_in(df: DataFrame, partition: list[str], order: list[str], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
