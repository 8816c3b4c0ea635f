"""Column builders: KPI expressions (K1-K9) and text labels."""

from promoscope.functions.kpi import (
    PROMO_RULES, revenue_before, revenue_after, sold_units_after, incremental_sold_units,
    incremental_revenue, margin_per_unit, discount_depth, with_kpis, with_metric_evaluation,
)
from promoscope.functions.labels import millions_label, thousands_label

__all__ = [
    "PROMO_RULES", "revenue_before", "revenue_after", "sold_units_after",
    "incremental_sold_units", "incremental_revenue", "margin_per_unit", "discount_depth",
    "with_kpis", "with_metric_evaluation", "millions_label", "thousands_label",
]
