"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: phrases that deny calibration
NEGATED = r"not a calibrated|not calibrated|uncalibrated"


def calibration_claim(text: Column) -> Column:
    return F.contains(F.regexp_replace(F.lower(text), NEGATED, ""), F.lit("calibrated"))
