"""Reshape (U1, U2)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def longer(df: DataFrame, ids: list[str], values: list[str], names_to: str,
           values_to: str) -> DataFrame:
    """U1, ``pivot_longer``: one output row per (input row, value column); a
    narrow transformation (Expand), no shuffle."""
    return df.unpivot(ids, values, names_to, values_to)

