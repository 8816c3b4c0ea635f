"""Entry point A: the five SQL reports as Spark SQL text.

The star's DataFrames are passed to ``spark.sql`` as parameters (``{fact}``,
``{products}``, ...), so no global view name is needed, and the values as
named parameter markers. Catalyst plans these texts like the DataFrame
versions in ``reports``: predicates pushed to the scans, partial aggregation
before each shuffle. Positional ``GROUP BY 1`` and ``ORDER BY 3`` (A4, O4) are
Spark SQL's ordinal grouping and ordering. The pricing rule is the same fixed
rule table as ``functions.kpi.PROMO_RULES``, joined as an inline table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from promoscope.functions.kpi import PROMO_RULES
from promoscope.operators.ranking import ONE_TASK_ROWS, global_rank
from promoscope.operators.star import dim_size, star_dim
from promoscope.sources.star import RetailStar


def _rules_values() -> str:
    rows = ", ".join(f"('{p}', CAST({f} AS DECIMAL(4,2)), CAST({o} AS DECIMAL(6,0)), {u})"
                     for p, f, o, u, _ in PROMO_RULES)
    return f"VALUES {rows} AS r(rule_promo, price_factor, price_offset, unit_factor)"


def _totals_cte(key: str) -> str:
    """The fact summed by one dimension key below the join, so the join meets a row per key (and a key present
    twice in the dimension still multiplies the totals, as joining the rows would)."""
    return f"""totals AS (
  SELECT f.{key},
         SUM(CAST(f.base_price * f.quantity_sold_before_promo AS DECIMAL(24,4))) AS rev_before,
         SUM(CAST((f.base_price * r.price_factor - r.price_offset) * f.quantity_sold_after_promo * r.unit_factor
              AS DECIMAL(24,4))) AS rev_after
  FROM {{fact}} f LEFT JOIN {_rules_values()} ON f.promo_type = r.rule_promo
  GROUP BY f.{key}
)"""


def _pct2(num: str, den: str) -> str:
    """num * 100 / den to two decimals, half away from zero, from whole numbers."""
    n, d = f"CAST({num} AS DECIMAL(38,0))", f"CAST({den} AS DECIMAL(38,0))"
    return (f"CAST((ABS({n}) * 20000BD + ABS({d})) DIV NULLIF(ABS({d}) * 2BD, 0BD) AS DOUBLE) "
            f"* SIGNUM(CAST({n} AS DOUBLE)) * SIGNUM(CAST({d} AS DOUBLE)) / 100D")


Q1 = """SELECT DISTINCT p.product_name, f.base_price
FROM {fact} f JOIN {products} p ON f.product_code = p.product_code
WHERE f.promo_type = :promo AND f.base_price > :min_price"""

Q2 = """SELECT city, COUNT(store_id) AS no_of_stores FROM {stores} GROUP BY 1 ORDER BY 2 DESC, 1"""

Q3 = f"""WITH {_totals_cte("campaign_id")}
SELECT c.campaign_name,
       CONCAT(CAST(ROUND(CAST(SUM(x.rev_before) AS DECIMAL(28,4)) * 0.000001BD, 2) AS STRING), 'M')
         AS total_revenue_before_promotion,
       CONCAT(CAST(ROUND(CAST(SUM(x.rev_after) AS DECIMAL(28,4)) * 0.000001BD, 2) AS STRING), 'M')
         AS total_revenue_after_promotion
FROM {{campaigns}} c JOIN totals x ON x.campaign_id = c.campaign_id
GROUP BY 1"""

Q4_CATEGORIES = f"""WITH by_product AS (
  SELECT f.product_code, SUM(f.quantity_sold_before_promo) AS before,
         SUM(IF(f.promo_type = 'BOGOF', f.quantity_sold_after_promo * 2, f.quantity_sold_after_promo)
             - f.quantity_sold_before_promo) AS isu
  FROM {{units}} f JOIN {{campaigns}} c ON f.campaign_id = c.campaign_id
  WHERE c.campaign_name = :campaign
  GROUP BY f.product_code),
by_category AS (
  SELECT p.category, {_pct2("SUM(x.isu)", "SUM(x.before)")} AS ISU_Percent
  FROM {{products}} p JOIN by_product x ON x.product_code = p.product_code
  GROUP BY 1)
SELECT category, ISU_Percent{{rank}} FROM by_category"""
Q4 = Q4_CATEGORIES.replace("{rank}", ", CAST(RANK() OVER (ORDER BY ISU_Percent DESC NULLS LAST) AS BIGINT) AS rank_order")

Q5 = f"""WITH {_totals_cte("product_code")}
SELECT p.product_name, p.category,
       {_pct2("(SUM(x.rev_after) - SUM(x.rev_before)) * 10000BD", "SUM(x.rev_before) * 10000BD")} AS IR_Percent
FROM {{products}} p JOIN totals x ON p.product_code = x.product_code
GROUP BY 1, 2
ORDER BY 3 DESC NULLS LAST, 1, 2
LIMIT :k"""


def _run(star: RetailStar, text: str, args: dict | None = None) -> DataFrame:
    """Dimensions go in behind the broadcast guard (a measuring job the first time): Catalyst takes a derived
    dimension for as large as what it is made from, and would shuffle the fact on a handful of keys."""
    spark = star.fact_events.sparkSession
    given = {"fact": lambda: star.fact_events, "units": lambda: star.unit_events, "stores": lambda: star.dim_stores,
             "products": lambda: star_dim(star, "dim_products"), "campaigns": lambda: star_dim(star, "dim_campaigns")}
    return spark.sql(text, args=args or {}, **{k: v() for k, v in given.items() if f"{{{k}}}" in text})


def q1_sql(star: RetailStar, min_price: int = 500, promo: str = "BOGOF") -> DataFrame:
    return _run(star, Q1, {"promo": promo, "min_price": min_price})


def q2_sql(star: RetailStar) -> DataFrame:
    return _run(star, Q2)


def q3_sql(star: RetailStar) -> DataFrame:
    return _run(star, Q3)


def q4_sql(star: RetailStar, campaign_name: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """W1 here is SQL's ``RANK() OVER (ORDER BY ..)``, one task over the aggregated categories, as long as the product
    dimension measures at most ``one_task_rows`` rows (there are no more categories); beyond, the categories of the
    SQL text are ranked by ``ranking.global_rank``."""
    if dim_size(star, "dim_products")[0] <= one_task_rows:
        return _run(star, Q4, {"campaign": campaign_name})
    groups = _run(star, Q4_CATEGORIES.replace("{rank}", ""), {"campaign": campaign_name})
    return global_rank(groups, ["ISU_Percent"], "rank_order", method="rank", descending=True, one_task_rows=one_task_rows)


def q5_sql(star: RetailStar, k: int = 5) -> DataFrame:
    return _run(star, Q5, {"k": k})
