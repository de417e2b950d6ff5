"""Supported resolutions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kegler.config import SCALE_FACTORS


def snapped(requested: Column) -> Column:
    """The largest supported factor that isn't above ``requested``, as ``config.snap_factor``; null if there is none."""
    return F.array_max(F.filter(F.array(*map(F.lit, SCALE_FACTORS)), lambda f: f <= requested))
