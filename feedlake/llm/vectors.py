"""What the vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for a vector that is not null or empty and whose components are all finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column, dtype=np.float64) -> np.ndarray:
    """A batch's vectors, all of one length, as a matrix."""
    return np.stack([np.asarray(x, dtype=dtype) for x in column])
