"""Laboratory formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, col

# Fluorometer calibration and method detection limit.
SLOPE = 2.8376
TAU = 1.9
DILUTION = 1.0
DETECTION_LIMIT = 0.001


def fluor_to_chla(
    fo: ColumnLike,
    fa: ColumnLike,
    vol_ext: ColumnLike,
    vol_fil: ColumnLike,
    slope: float = SLOPE,
    tau: float = TAU,
    dilution: float = DILUTION,
) -> Column:
    """Chlorophyll-a from fluorescence before and after acidification."""
    factor = F.lit((1.0 / slope) * (tau / (tau - 1.0)) * dilution)
    return factor * (col(fo) - col(fa)) * F.try_divide(col(vol_ext), col(vol_fil))
