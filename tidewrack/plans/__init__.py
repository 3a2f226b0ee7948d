"""Named queries over the test tables and the SQL each is checked against."""

from . import (  # noqa: F401
    calibration,
    climatology,
    filtering,
    flagging,
    logger,
    quality_checks,
    robust_statistics,
    schemas,
    scans,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
