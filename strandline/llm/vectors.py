"""What both vector searches share: which rows take part, and packed batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.size(column) > 0, F.lit(False)) & F.forall(F.transform(column, lambda x: x.cast("double")), good)


def one_row_an_id(rows: DataFrame, key: str) -> DataFrame:
    """Rows without a null id; of rows that repeat an id, one."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key])


def stack(values, dtype) -> np.ndarray:
    """Binary or list cells of equal length as a matrix."""
    values = list(values)
    if values and isinstance(values[0], (bytes, bytearray, memoryview)):
        return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)
    return np.array([np.asarray(v, dtype) for v in values], dtype).reshape(len(values), -1)
