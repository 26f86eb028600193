"""Tables of integer vectors for the operators that need exact arithmetic on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows for each task of a table of vectors at least and at most, and tasks for each core while that most is not reached.
TASK_ROWS, MOST_ROWS, PER_CORE = 4096, 1 << 20, 3
#: Bytes of 64-bit components that a step of a task, or a block that reaches the driver, holds at most.
BLOCK_BYTES = 1 << 22


def whole(vector: str) -> Column:
    """Whether ``vector`` is there and has neither a null nor a non-finite component."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(vector: str, scale: int, limit: int) -> Column:
    """floor(scale * x) of every component, held within ``limit`` on both sides (less than 2^31), so that sums of products fit in a long."""
    held = lambda x: F.greatest(F.least(F.floor(x), F.lit(limit).cast("long")), F.lit(-limit).cast("long"))
    in_long = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(9e18)), F.lit(-9e18))
    return F.transform(vector, lambda x: held(in_long(x)).cast("int"))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly, whatever files they came in: to a few tasks for each core, fewer if they are few, and more if a task had too many.

    What a task sends on does not grow with its rows, so tasks are no more than that.
    """
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    return rows.repartition(max(1, min(-(-n // TASK_ROWS), PER_CORE * cores), -(-n // MOST_ROWS)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of 64-bit integers; a shorter vector is filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out
