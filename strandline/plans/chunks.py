"""Chunk sizes of the output: column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20


def values(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def time_chunk(shape: Column, itemsize: Column | int) -> Column:
    """Time steps a chunk: all of them for variables below 4 MiB, else as many as fit, one at least."""
    item = F.lit(itemsize) if isinstance(itemsize, int) else itemsize
    steps = F.element_at(shape, 1)
    rest = F.greatest(values(F.slice(shape, 2, F.greatest(F.size(shape) - 1, F.lit(0)))) * item, F.lit(1))
    return F.when(values(shape) * item < CHUNK_BYTES, steps.cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(F.lit(CHUNK_BYTES) / rest).cast("long")))


def conforms(is_time: Column, has_time: Column, shape: Column, chunks: Column, itemsize: Column) -> Column:
    """Whether a variable of an output is laid out well: contiguous (null chunks) or in one chunk; or, with
    time and more dimensions, in chunks that one more step would bring to 4 MiB."""
    whole = chunks.isNull() | (chunks == shape)
    step = values(F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))) * itemsize
    return F.when(is_time, whole).otherwise(whole | (has_time & (F.size(shape) > 1) & ((F.element_at(chunks, 1) + 1) * step >= CHUNK_BYTES)))
