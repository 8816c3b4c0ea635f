"""Independent DuckDB SQL for every registered query (the correctness oracle).

The oracle is written the plain way: the star is rebuilt from the test tables
with the same adapter mapping, the R reports run over the row-level left-joined
fact (as the R script does), and the pricing rule is a joined rule table rather
than a CASE chain. The Spark plans pre-aggregate below joins and use the CASE
chain, so agreement checks both formulations against each other.

Output conventions shared with ``__spark_entry__``: money leaves as DOUBLE
after exact DECIMAL sums, dates as ISO text, counts as BIGINT; medians,
standard deviations, quartiles and means of per-row ratios are rounded to 4.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The adapter (same mapping as promoscope.sources.testdata_star) and the
# promotion rule table (same fixed values as promoscope.functions.kpi).
_STAR = """
fact_events AS (
  SELECT concat_ws('-', cast(l.l_orderkey AS VARCHAR), cast(l.l_linenumber AS VARCHAR)) AS event_id,
         cast(l.l_suppkey AS VARCHAR) AS store_id,
         cast(year(l.l_shipdate) AS VARCHAR) AS campaign_id,
         cast(l.l_partkey AS VARCHAR) AS product_code,
         cast(p.p_retailprice AS DECIMAL(12,2)) AS base_price,
         CASE l.l_returnflag || l.l_linestatus
              WHEN 'AF' THEN 'BOGOF' WHEN 'AO' THEN '500 Cashback' WHEN 'NF' THEN '50% OFF'
              WHEN 'NO' THEN '33% OFF' WHEN 'RF' THEN '25% OFF' END AS promo_type,
         cast(l.l_quantity AS BIGINT) AS quantity_sold_before_promo,
         greatest(cast(l.l_quantity AS BIGINT) + 3 * cast(floor(l.l_discount * 100 + 0.5) AS BIGINT)
                  - 5 * cast(floor(l.l_tax * 100 + 0.5) AS BIGINT), 0) AS quantity_sold_after_promo
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
dim_campaigns AS (
  SELECT cast(y AS VARCHAR) AS campaign_id, 'FY' || cast(y AS VARCHAR) AS campaign_name,
         make_date(y, 1, 1) AS start_date, make_date(y, 12, 31) AS end_date
  FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders WHERE o_orderdate IS NOT NULL)
),
dim_products AS (
  SELECT cast(p_partkey AS VARCHAR) AS product_code, p_name AS product_name, p_type AS category FROM part
),
dim_stores AS (
  SELECT cast(s.s_suppkey AS VARCHAR) AS store_id, n.n_name AS city
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
),
promo_rules AS (
  SELECT rule_promo, cast(price_factor AS DECIMAL(4,2)) AS price_factor,
         cast(price_offset AS DECIMAL(6,0)) AS price_offset, unit_factor, depth
  FROM (VALUES ('BOGOF', 0.5, 0, 2, 'Medium Margin Loss'),
               ('500 Cashback', 1, 500, 1, 'Controlled Margin Loss'),
               ('50% OFF', 0.5, 0, 1, 'High Margin Loss'),
               ('33% OFF', 0.67, 0, 1, 'High Margin Loss'),
               ('25% OFF', 0.75, 0, 1, 'High Margin Loss'))
       AS r(rule_promo, price_factor, price_offset, unit_factor, depth)
),
kpi_sql AS (
  SELECT f.*,
         cast(f.base_price * f.quantity_sold_before_promo AS DECIMAL(24,4)) AS revenue_before_promo,
         cast((f.base_price * r.price_factor - r.price_offset) * f.quantity_sold_after_promo * r.unit_factor
              AS DECIMAL(24,4)) AS revenue_after_promo,
         CASE WHEN f.promo_type = 'BOGOF' THEN f.quantity_sold_after_promo * 2
              ELSE f.quantity_sold_after_promo END - f.quantity_sold_before_promo AS incremental_sold_units
  FROM fact_events f LEFT JOIN promo_rules r ON f.promo_type = r.rule_promo
),
enriched AS (
  SELECT f.*, c.campaign_name, c.start_date, c.end_date, p.product_name, p.category, s.city
  FROM fact_events f
  LEFT JOIN dim_campaigns c ON f.campaign_id IS NOT DISTINCT FROM c.campaign_id
  LEFT JOIN dim_products p ON f.product_code IS NOT DISTINCT FROM p.product_code
  LEFT JOIN dim_stores s ON f.store_id IS NOT DISTINCT FROM s.store_id
),
kpi_r0 AS (
  SELECT e.*,
         cast(e.base_price * e.quantity_sold_before_promo AS DECIMAL(24,4)) AS revenue_before_promo,
         coalesce(cast((e.base_price * r.price_factor - r.price_offset) * e.quantity_sold_after_promo
                       * r.unit_factor AS DECIMAL(24,4)), 0) AS revenue_after_promo,
         CASE WHEN e.promo_type IS NULL THEN NULL
              WHEN e.promo_type = 'BOGOF' THEN e.quantity_sold_after_promo * 2
              ELSE e.quantity_sold_after_promo END AS sold_units_after_promo,
         r.depth AS discount_depth
  FROM enriched e LEFT JOIN promo_rules r ON e.promo_type = r.rule_promo
),
kpi_r AS (
  SELECT *, sold_units_after_promo - quantity_sold_before_promo AS incremental_sold_units,
         cast(revenue_after_promo - revenue_before_promo AS DECIMAL(24,4)) AS incremental_revenue,
         cast(revenue_after_promo AS DOUBLE) / nullif(cast(quantity_sold_after_promo AS DOUBLE), 0)
           AS margin_per_unit
  FROM kpi_r0
)"""
# ---------------------------------------------------------------------------

_ENRICHED_COLS = """event_id, store_id, campaign_id, product_code, cast(base_price AS DOUBLE) AS base_price,
  promo_type, quantity_sold_before_promo, quantity_sold_after_promo, campaign_name,
  cast(start_date AS VARCHAR) AS start_date, cast(end_date AS VARCHAR) AS end_date,
  product_name, category, city"""

_KPI_COLS = _ENRICHED_COLS + """, cast(revenue_before_promo AS DOUBLE) AS revenue_before_promo,
  cast(revenue_after_promo AS DOUBLE) AS revenue_after_promo, sold_units_after_promo, incremental_sold_units"""

#: The texts that the loaders' keys append (the same as in ``catalog.HARD_TEXTS``), by p_partkey.
_HARD = (r"list_extract(['''', '\', '),(', ';' || chr(10), chr(9) || '''\''', '''''', ', NULL', chr(10), ');', '\"', 'NA', ' é'], "
         "cast(p_partkey % 12 + 1 AS INT))").replace('\\"', '"')


def _pct2(num: str, den: str) -> str:
    """num * 100 / den to two decimals, half away from zero, from whole numbers."""
    n, d = f"cast({num} AS HUGEINT)", f"cast({den} AS HUGEINT)"
    return (f"CASE WHEN {d} <> 0 THEN cast((abs({n}) * 20000 + abs({d})) // (2 * abs({d})) AS DOUBLE) "
            f"* sign({n}) * sign({d}) / 100.0 END")


#: Charts by key: the report's key, label and value.
_AXES = {
    "top_stores_axis_order": ("top10_stores_ir", "store_id", "total_incremental_revenue"),
    "bottom_stores_axis_order": ("bottom10_stores_isu", "store_id", "total_incremental_sold_units"),
    "city_axis_order": ("city_performance", "city", "total_incremental_revenue"),
    "promo_ir_axis_order": ("promo_ir", "promo_type", "total_incremental_revenue"),
    "promo_isu_axis_order": ("promo_isu", "promo_type", "total_incremental_sold_units"),
    "category_axis_order": ("category_lift", "category", "total_incremental_sold_units"),
    "top_products_axis_order": ("top10_products", "product_name", "total_incremental_sold_units"),
    "bottom_products_axis_order": ("bottom10_products", "product_name", "total_incremental_sold_units"),
}


def _units(c: str) -> str:
    """A summed amount in whole 1/10000 units."""
    return f"sum(cast({c} * 10000 AS HUGEINT))"


def _ir_pct(prefix: str = "") -> str:
    a, b = _units(prefix + "revenue_after_promo"), _units(prefix + "revenue_before_promo")
    return _pct2(f"({a} - {b})", b)


_IR_PCT = _ir_pct()

_STORES = """SELECT store_id, min(city) AS city, {expr} AS {name} FROM kpi_r GROUP BY store_id
ORDER BY {name} {dir} NULLS LAST, store_id LIMIT 10"""

_PROMO_STATS = """SELECT promo_type,
  cast(sum({v}) AS DOUBLE) / count({v}) AS avg_{v},
  round(quantile_cont(cast({v} AS DOUBLE), 0.5), 4) AS median_{v},
  round(stddev_samp(cast({v} AS DOUBLE)), 4) AS sd_{v},
  count(*) AS store_count
FROM kpi_r GROUP BY promo_type"""

_PRODUCT_LIFT = """SELECT product_code, product_name,
  {isu_type}(coalesce(sum(incremental_sold_units), 0) AS {isu_t}) AS total_incremental_sold_units,
  cast(coalesce(sum(incremental_revenue), 0) AS DOUBLE) AS total_incremental_revenue,
  cast(sum(incremental_sold_units) AS DOUBLE) / count(incremental_sold_units) AS avg_lift_per_store
FROM kpi_r GROUP BY product_code, product_name"""

_BA_CTE = """totals AS (
  SELECT {a}, cast(coalesce(sum(quantity_sold_before_promo), 0) AS BIGINT) AS total_before,
         cast(coalesce(sum(quantity_sold_after_promo), 0) AS BIGINT) AS total_after
  FROM kpi_r GROUP BY {a})"""

_BA_BODY = """SELECT {a}, 'total_before' AS sale_type, total_before AS total_units FROM totals
UNION ALL SELECT {a}, 'total_after' AS sale_type, total_after AS total_units FROM totals"""

_TOP_STORES = """ranked AS (
  SELECT store_id, city, promo_type, total,
         row_number() OVER (PARTITION BY store_id, city ORDER BY total DESC NULLS LAST, promo_type ASC NULLS LAST) AS rn
  FROM (SELECT store_id, city, promo_type, cast(coalesce(sum(incremental_revenue), 0) AS DECIMAL(38,4)) AS total
        FROM kpi_r GROUP BY store_id, city, promo_type)),
top_stores AS (SELECT * FROM ranked WHERE rn <= 10)"""

_THOUSANDS = "'₹' || format('{{:,.1f}}', round(cast(coalesce(sum({c}), 0) AS DECIMAL(28,4)) * 0.001, 1)) || 'K'"

_BOX_CTE = """v AS (SELECT promo_type, cast(incremental_revenue AS DOUBLE) AS x FROM kpi_r
      WHERE incremental_revenue IS NOT NULL),
q AS (SELECT promo_type, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
      FROM v GROUP BY promo_type)"""

_BOX_BODY = """SELECT v.promo_type, round(q.q1, 4) AS q1, round(q.med, 4) AS median, round(q.q3, 4) AS q3,
  round(min(x) FILTER (WHERE x >= q.q1 - 1.5 * (q.q3 - q.q1)), 4) AS lower_whisker,
  round(max(x) FILTER (WHERE x <= q.q3 + 1.5 * (q.q3 - q.q1)), 4) AS upper_whisker,
  count(*) FILTER (WHERE x < q.q1 - 1.5 * (q.q3 - q.q1) OR x > q.q3 + 1.5 * (q.q3 - q.q1)) AS outliers,
  count(*) AS n
FROM v JOIN q ON v.promo_type IS NOT DISTINCT FROM q.promo_type
GROUP BY v.promo_type, q.q1, q.med, q.q3"""

_EFFICIENCY = """SELECT promo_type,
  cast(sum(incremental_sold_units) AS DOUBLE) / count(incremental_sold_units) AS avg_incremental_sold_units,
  cast(sum(incremental_revenue) AS DOUBLE) / count(incremental_revenue) AS avg_incremental_revenue,
  round(avg(margin_per_unit), 4) AS avg_margin_per_unit
FROM kpi_r GROUP BY promo_type"""

_NOT_NULL = {
    "fact_events": ["event_id", "store_id", "campaign_id", "product_code", "base_price",
                    "quantity_sold_before_promo", "quantity_sold_after_promo"],
    "dim_campaigns": ["campaign_id", "campaign_name", "start_date", "end_date"],
    "dim_products": ["product_code", "product_name", "category"],
    "dim_stores": ["store_id", "city"],
}
_PK = {"dim_campaigns": "campaign_id", "dim_products": "product_code", "dim_stores": "store_id"}


def _quality_sql() -> str:
    parts = []
    for t, cols in _NOT_NULL.items():
        for c in cols:
            parts.append(f"SELECT '{t}.{c}.nulls' AS \"check\", cast(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS violations FROM {t}")
    for t, k in _PK.items():
        parts.append(f"SELECT '{t}.{k}.duplicate_keys' AS \"check\", cast(count(*) AS BIGINT) AS violations "
                     f"FROM (SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1)")
    for t, k in _PK.items():
        parts.append(f"SELECT 'fact_events.{k}.orphans' AS \"check\", cast(count(*) AS BIGINT) AS violations "
                     f"FROM fact_events f WHERE NOT EXISTS (SELECT 1 FROM {t} d WHERE d.{k} = f.{k})")
    return "\nUNION ALL ".join(parts)


def _q(body: str, extra: str = "") -> str:
    ctes = _STAR + (",\n" + extra if extra else "")
    return "WITH " + ctes.strip() + "\n" + body.strip()


def oracle_queries() -> dict[str, str]:
    q = {}
    q["q1_high_value_bogof"] = _q("""
SELECT DISTINCT p.product_name, cast(f.base_price AS DOUBLE) AS base_price
FROM fact_events f JOIN dim_products p ON f.product_code = p.product_code
WHERE f.promo_type = 'BOGOF' AND f.base_price > 950""")
    q["q2_stores_by_city"] = _q("""
SELECT city, count(store_id) AS no_of_stores FROM dim_stores GROUP BY city ORDER BY no_of_stores DESC, city""")
    q["q3_campaign_revenue"] = _q("""
SELECT c.campaign_name,
  cast(round(cast(sum(k.revenue_before_promo) AS DECIMAL(28,4)) * 0.000001, 2) AS VARCHAR) || 'M'
    AS total_revenue_before_promotion,
  cast(round(cast(sum(k.revenue_after_promo) AS DECIMAL(28,4)) * 0.000001, 2) AS VARCHAR) || 'M'
    AS total_revenue_after_promotion
FROM dim_campaigns c JOIN kpi_sql k ON k.campaign_id = c.campaign_id
GROUP BY c.campaign_name""")
    q["q4_campaign_isu_rank"] = _q(f"""
SELECT category, ISU_Percent, cast(rank() OVER (ORDER BY ISU_Percent DESC NULLS LAST) AS BIGINT) AS rank_order
FROM by_category""", f"""by_category AS (
  SELECT p.category,
         {_pct2("sum(k.incremental_sold_units)", "sum(k.quantity_sold_before_promo)")} AS ISU_Percent
  FROM dim_products p JOIN kpi_sql k ON k.product_code = p.product_code
  JOIN dim_campaigns c ON k.campaign_id = c.campaign_id
  WHERE c.campaign_name = 'FY1998'
  GROUP BY p.category)""")
    q["q5_top5_products_ir"] = _q(f"""
SELECT p.product_name, p.category,
  {_ir_pct("k.")} AS IR_Percent
FROM dim_products p JOIN kpi_sql k ON p.product_code = k.product_code
GROUP BY p.product_name, p.category
ORDER BY IR_Percent DESC NULLS LAST, product_name, category LIMIT 5""")
    q["enriched_fact"] = _q(f"SELECT {_ENRICHED_COLS} FROM enriched")
    q["kpi_fact"] = _q(f"SELECT {_KPI_COLS} FROM kpi_r")
    q["overall_ir_pct"] = _q(f"SELECT {_IR_PCT} AS IR_Percentage FROM kpi_r")
    q["enrich_with_overall_ir"] = _q(f"SELECT {_KPI_COLS}, s.IR_Percentage FROM kpi_r, "
                                     f"(SELECT {_IR_PCT} AS IR_Percentage FROM kpi_r) s")
    q["overall_isu_pct"] = _q("""
SELECT CASE WHEN count(sold_units_after_promo) = count(*) THEN
  cast((sum(sold_units_after_promo) - sum(quantity_sold_before_promo)) * 100 AS DOUBLE)
  / nullif(cast(sum(quantity_sold_before_promo) AS DOUBLE), 0) END AS ISU_Percentage
FROM kpi_r""")
    ir_total = "cast(coalesce(sum(incremental_revenue), 0) AS DOUBLE)"
    isu_total = "cast(coalesce(sum(incremental_sold_units), 0) AS BIGINT)"
    q["top10_stores_ir"] = _q(_STORES.format(expr=ir_total, name="total_incremental_revenue", dir="DESC"))
    q["bottom10_stores_ir"] = _q(_STORES.format(expr=ir_total, name="total_incremental_revenue", dir="ASC"))
    q["bottom10_stores_isu"] = _q(_STORES.format(expr=isu_total, name="total_incremental_sold_units", dir="ASC"))
    q["top10_stores_isu"] = _q(_STORES.format(expr=isu_total, name="total_incremental_sold_units", dir="DESC"))
    q["city_performance"] = _q("""
SELECT city, cast(coalesce(sum(incremental_revenue), 0) AS DOUBLE) AS total_incremental_revenue,
  cast(sum(incremental_revenue) AS DOUBLE) / count(incremental_revenue) AS avg_incremental_revenue,
  count(DISTINCT store_id) + max(CASE WHEN store_id IS NULL THEN 1 ELSE 0 END) AS store_count
FROM kpi_r GROUP BY city""")
    q["top_stores_by_promo"] = _q("""
SELECT store_id, city, promo_type, cast(total AS DOUBLE) AS total_incremental_revenue FROM top_stores""",
                                  _TOP_STORES)
    q["top_stores_summary"] = _q("""
SELECT city, promo_type, cast(sum(total) AS DOUBLE) / count(total) AS avg_incremental_revenue,
  count(*) AS count_of_top_stores
FROM top_stores GROUP BY city, promo_type""", _TOP_STORES)
    q["promo_ir"] = _q(f"SELECT promo_type, {ir_total} AS total_incremental_revenue FROM kpi_r GROUP BY promo_type")
    q["promo_isu"] = _q(f"SELECT promo_type, {isu_total} AS total_incremental_sold_units FROM kpi_r GROUP BY promo_type")
    q["promo_ir_stats"] = _q(_PROMO_STATS.format(v="incremental_revenue"))
    q["promo_isu_stats"] = _q(_PROMO_STATS.format(v="incremental_sold_units"))
    q["metric_evaluation"] = _q(f"""
SELECT {_KPI_COLS}, cast(incremental_revenue AS DOUBLE) AS incremental_revenue, margin_per_unit, discount_depth
FROM kpi_r""")
    q["promo_efficiency"] = _q(_EFFICIENCY)
    q["category_lift"] = _q("""
SELECT category, cast(coalesce(sum(incremental_sold_units), 0) AS BIGINT) AS total_incremental_sold_units,
  cast(coalesce(sum(incremental_revenue), 0) AS DOUBLE) AS total_incremental_revenue,
  cast(sum(incremental_sold_units) AS DOUBLE) / count(incremental_sold_units) AS avg_lift_per_store
FROM kpi_r GROUP BY category""")
    q["product_lift"] = _q(_PRODUCT_LIFT.format(isu_type="cast", isu_t="BIGINT"))
    lift = _PRODUCT_LIFT.format(isu_type="cast", isu_t="DOUBLE")
    q["top10_products"] = _q(f"""
SELECT * FROM ({lift}) ORDER BY total_incremental_sold_units DESC NULLS LAST, product_code LIMIT 10""")
    q["bottom10_products"] = _q(f"""
SELECT * FROM ({lift}) ORDER BY total_incremental_sold_units ASC NULLS LAST, product_code LIMIT 10""")
    q["category_promo_effectiveness"] = _q("""
SELECT category, promo_type,
  cast(sum(incremental_sold_units) AS DOUBLE) / count(incremental_sold_units) AS avg_incremental_units,
  cast(sum(incremental_revenue) AS DOUBLE) / count(incremental_revenue) AS avg_incremental_revenue
FROM kpi_r GROUP BY category, promo_type""")
    q["category_before_after"] = _q(_BA_BODY.format(a="category"), _BA_CTE.format(a="category"))
    q["product_before_after"] = _q(_BA_BODY.format(a="product_name"), _BA_CTE.format(a="product_name"))
    q["category_product_summary"] = _q(f"""
SELECT category, product_name,
  cast(coalesce(sum(quantity_sold_before_promo), 0) AS BIGINT) AS Quantity_before_Promo,
  {_THOUSANDS.format(c='revenue_before_promo')} AS Revenue_before_Promo,
  cast(coalesce(sum(quantity_sold_after_promo), 0) AS BIGINT) AS Quantity_after_promo,
  {_THOUSANDS.format(c='revenue_after_promo')} AS Revenue_after_promo,
  {_THOUSANDS.format(c='incremental_revenue')} AS Incremental_revenue,
  cast(coalesce(sum(incremental_sold_units), 0) AS BIGINT) AS Incremental_sold_units
FROM kpi_r GROUP BY category, product_name""")
    q["campaign_promo_analysis"] = _q("""
SELECT campaign_name, promo_type,
  cast(coalesce(sum(quantity_sold_before_promo), 0) AS BIGINT) AS Quantity_before_promo,
  cast(coalesce(sum(quantity_sold_after_promo), 0) AS BIGINT) AS Quantity_after_promo,
  cast(coalesce(sum(incremental_revenue), 0) AS DOUBLE) AS Incremental_Revenue,
  cast(coalesce(sum(incremental_sold_units), 0) AS BIGINT) AS Incremental_Sold_Units
FROM kpi_r GROUP BY campaign_name, promo_type
ORDER BY campaign_name ASC NULLS LAST, Quantity_before_promo DESC NULLS LAST""")
    q["product_axis_order"] = _q("""
SELECT pba.product_name, pba.sale_type, pba.total_units, cast(pos.axis_position AS BIGINT) AS axis_position
FROM pba LEFT JOIN pos ON pba.product_name IS NOT DISTINCT FROM pos.product_name""",
                                 _BA_CTE.format(a="product_name") + ",\npba AS (" + _BA_BODY.format(a="product_name")
                                 + """),
means AS (SELECT product_name, avg(cast(total_units AS DOUBLE)) AS mu FROM pba GROUP BY product_name),
pos AS (SELECT product_name,
               row_number() OVER (ORDER BY mu ASC NULLS LAST, product_name ASC NULLS LAST) AS axis_position
        FROM means)""")
    q["ir_boxplot_by_promo"] = _q(_BOX_BODY, _BOX_CTE)
    q["promo_tradeoff_points"] = _q(f"""
SELECT promo_type AS label, avg_incremental_sold_units AS x, avg_margin_per_unit AS y FROM ({_EFFICIENCY})""")
    q["ingest_insert_tuples"] = ("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
    hard = ("SELECT p_partkey, {name} AS p_name, CASE WHEN p_partkey % 5 > 0 THEN {brand} END AS p_brand, "
            "CASE WHEN p_partkey % 7 > 0 THEN p_size END AS p_size FROM (SELECT *, " + _HARD + " AS odd FROM part)")
    q["ingest_hard_tuples"] = hard.format(name="p_name || odd", brand="odd || p_brand")
    trimmed = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    q["csv_scan_hard"] = hard.format(name=trimmed.format("p_name || odd"), brand=trimmed.format("odd || p_brand"))
    q["quality_checks"] = _q(_quality_sql())
    q["csv_scan_typed"] = _q("""
SELECT f.event_id, f.store_id, f.campaign_id, f.product_code, cast(f.base_price AS DOUBLE) AS base_price,
  f.promo_type, f.quantity_sold_before_promo, f.quantity_sold_after_promo, c.campaign_name,
  cast(c.start_date AS VARCHAR) AS start_date, cast(c.end_date AS VARCHAR) AS end_date
FROM fact_events f LEFT JOIN dim_campaigns c ON f.campaign_id IS NOT DISTINCT FROM c.campaign_id""")
    q["null_safe_left_join"] = _q("""
SELECT f.event_id, f.store_id, s.city
FROM fact_events f LEFT JOIN dim_stores s ON f.store_id IS NOT DISTINCT FROM s.store_id""")
    for k in ("q1_high_value_bogof", "q2_stores_by_city", "q3_campaign_revenue", "q4_campaign_isu_rank",
              "q5_top5_products_ir"):
        q[k + "_sql"] = q[k]          # the Spark SQL text versions answer the same question
        q[k + "_collated"] = q[k]     # so do promos in mixed case, compared without case
    for name, (key, label, value) in _AXES.items():
        # the report is wrapped, so its own CTEs stay inside
        q[name] = f"""
WITH rows_ AS ({q[key]}),
means AS (SELECT {label}, avg(cast({value} AS DOUBLE)) AS mu FROM rows_ GROUP BY {label}),
pos AS (SELECT {label}, row_number() OVER (ORDER BY mu ASC NULLS LAST, {label} ASC NULLS LAST) AS axis_position FROM means)
SELECT rows_.*, pos.axis_position FROM rows_ LEFT JOIN pos ON rows_.{label} IS NOT DISTINCT FROM pos.{label}"""
    return q
