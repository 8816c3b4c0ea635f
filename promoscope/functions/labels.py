"""Text labels of money totals (F3, F4), built from exact decimals so that the
half-way rounding happens once, half away from zero, before formatting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed label formats: "<x.xx>M" for millions, "₹<#,##0.0>K" for thousands.
MILLIONS_SUFFIX = "M"
THOUSANDS_PREFIX = "₹"
THOUSANDS_SUFFIX = "K"

_EXACT = "decimal(28,4)"


def millions_label(amount: Column) -> Column:
    """amount / 1e6 rounded to 2 decimals, always printed with 2 (``82.50M``)."""
    scaled = F.round(amount.cast(_EXACT) * F.lit(Decimal("0.000001")), 2)
    return F.concat(scaled.cast("string"), F.lit(MILLIONS_SUFFIX))


def thousands_label(amount: Column) -> Column:
    """amount / 1e3 rounded to 1 decimal, thousands separators, one decimal
    pinned (``₹1,234.6K``)."""
    scaled = F.round(amount.cast(_EXACT) * F.lit(Decimal("0.001")), 1)
    return F.concat(F.lit(THOUSANDS_PREFIX), F.format_number(scaled, 1), F.lit(THOUSANDS_SUFFIX))
