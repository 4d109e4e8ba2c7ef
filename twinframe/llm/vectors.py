"""Vectors of array columns as numpy matrices, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def width(df: DataFrame, vec_col: str) -> int:
    """The greatest length of a vector; 0 for an empty table."""
    return df.agg(F.max(F.when(F.col(vec_col).isNotNull(), F.size(vec_col)))).first()[0] or 0


def finite_rows(column: pa.ListArray, d: int, shorter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(which lists are vectors of ``d`` finite numbers, those vectors as doubles). ``shorter``: fewer numbers count as followed by zeros."""
    known = pc.is_valid(column).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(sizes)
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    fit = known & (odd[ends] == odd[ends - sizes]) & ((sizes <= d) if shorter else (sizes == d))
    out = np.zeros((int(fit.sum()), d))
    row = np.repeat(np.cumsum(fit) - 1, sizes)
    place = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
    use = np.repeat(fit, sizes)
    out[row[use], place[use]] = values[use]
    return fit, out
