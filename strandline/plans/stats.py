"""Figures about a collection and its orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import values


def collection_stats(files: DataFrame) -> DataFrame:
    """files: path, group_id, variables. One row: files, groups, bytes, and the largest of each kind (ties: smallest name)."""
    sizes = files.withColumn("_bytes", F.aggregate("variables", F.lit(0).cast("long"), lambda a, v: a + v["itemsize"] * values(v["shape"])))
    groups = sizes.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b"), F.max(F.size("variables")).alias("vars"))
    first = lambda col: F.min_by("group_id", F.struct(-F.col(col), F.col("group_id")))
    return groups.agg(F.sum("n").alias("n_files"), F.count("*").alias("n_groups"), F.sum("b").alias("bytes"), first("vars").alias("most_variables"), first("n").alias("most_files"))


def order_stats(orders: DataFrame) -> DataFrame:
    """Orders, how many are auxiliary only, and of the others the one with most bytes (ties: smallest path, then variable)."""
    data = F.when(F.col("primary_var") != "auxiliary", F.struct(-F.col("n_bytes"), F.col("ts_path_template"), F.col("primary_var"), F.col("ts_string")))
    name = F.concat_ws(".", "ts_path_template", "primary_var", "ts_string")
    return orders.agg(
        F.count("*").alias("n_orders"), F.count_if(F.col("primary_var") == "auxiliary").alias("n_auxiliary"), F.max(F.size("hf_paths")).alias("most_files"),
        F.max(F.when(F.col("primary_var") != "auxiliary", F.col("n_bytes"))).alias("largest_bytes"), F.min_by(name, data).alias("largest"),
    )
