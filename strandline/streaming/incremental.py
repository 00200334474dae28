"""Incremental runs: orders whose output is complete already are skipped by an anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame


def remaining(orders: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    return orders.join(done.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


def skipped(orders: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    return orders.join(done.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_semi")
