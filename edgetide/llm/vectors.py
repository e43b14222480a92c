"""Integer vectors: components floored at a scale, kept as whole doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From here on a double has no fraction.
WHOLE = 2.0 ** 52


def _floor(x: Column, scale: int) -> Column:
    scaled = x.cast("double") * scale
    return F.when(F.abs(scaled) < WHOLE, F.floor(scaled).cast("double")).otherwise(scaled)


def floored(rows: DataFrame, scale: int, vector: str = "embedding", name: str = "vec") -> DataFrame:
    """``name`` as floor(scale * x) of each component.

    Rows whose vector is null or empty, or holds a null, a NaN, an infinity or a component that
    is infinite once scaled, are left out.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))))
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).withColumn(
        name, F.transform(vector, lambda x: _floor(x, scale)))
