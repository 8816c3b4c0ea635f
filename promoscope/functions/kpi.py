"""Domain expressions K1-K9 as reusable Column builders.

Two conventions exist for promotions that are NULL or unknown:

* ``"sql"`` (the five SQL reports): revenue after promo is NULL (and skipped by
  SUM); units after promo keep the raw quantity.
* ``"r"`` (the R reports): revenue after promo is 0; units after promo are NULL
  when the promo is NULL and the raw quantity when it is a non-NULL unknown.

All money stays exact. Row-level outputs carry DECIMAL columns (``MONEY``);
aggregations use the same amounts as integer counts of 1/10000 of the currency
(``*_e4`` DECIMAL(38,0) columns), built from integer arithmetic on the price in
cents, and sum them as such. Long multiplication keeps the per-row work inside
generated code (Spark multiplies DECIMALs through BigDecimal); only quantities
too large for it take the DECIMAL path, so every legal price and quantity gives
the same amount in both forms.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscope.schemas import MONEY

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (promo labels, pricing factors,
# margin-loss classes). Row: promo_type, price factor, price offset, unit
# factor applied to units after promo, discount-depth class.
PROMO_RULES = (
    ("BOGOF", "0.5", "0", 2, "Medium Margin Loss"),
    ("500 Cashback", "1", "500", 1, "Controlled Margin Loss"),
    ("50% OFF", "0.5", "0", 1, "High Margin Loss"),
    ("33% OFF", "0.67", "0", 1, "High Margin Loss"),
    ("25% OFF", "0.75", "0", 1, "High Margin Loss"),
)
# ---------------------------------------------------------------------------

BOGOF = "BOGOF"
E4 = 10000                      # money units per currency unit in ``*_e4`` columns
for _label, _f, _o, _u, _d in PROMO_RULES:     # cents arithmetic needs <= 2 decimals
    assert (Decimal(_f) * 100) % 1 == 0 and (Decimal(_o) * 100) % 1 == 0, _label
CONVENTIONS = ("sql", "r")

PRICE_COL = "base_price"
PROMO_COL = "promo_type"
QTY_BEFORE = "quantity_sold_before_promo"
QTY_AFTER = "quantity_sold_after_promo"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def promo_is(promo, label: str, collation: str | None = None) -> Column:
    """Equality on the promo label; ``collation`` (e.g. ``"UNICODE_CI_AI"``)
    gives the case/accent-insensitive match of the source database."""
    p = _col(promo)
    if collation:
        p = F.collate(p, collation)
    return p == F.lit(label)


def revenue_before(price=PRICE_COL, qty=QTY_BEFORE) -> Column:
    """K1: base_price x quantity before promo."""
    return (_col(price) * _col(qty)).cast(MONEY)


def revenue_after(price=PRICE_COL, qty=QTY_AFTER, promo=PROMO_COL,
                  convention: str = "sql", collation: str | None = None) -> Column:
    """K2: promo-dependent revenue after promo (exact decimal)."""
    assert convention in CONVENTIONS
    price, qty = _col(price), _col(qty)
    expr = None
    for label, factor, offset, unit_factor, _ in PROMO_RULES:
        value = price * F.lit(Decimal(factor))
        if Decimal(offset):
            value = value - F.lit(Decimal(offset))
        value = value * qty
        if unit_factor != 1:
            value = value * F.lit(unit_factor)
        cond = promo_is(promo, label, collation)
        expr = F.when(cond, value.cast(MONEY)) if expr is None else expr.when(cond, value.cast(MONEY))
    if convention == "r":
        expr = expr.otherwise(F.lit(Decimal(0)).cast(MONEY))
    return expr


def revenue_after_by_rule_table(df: DataFrame, convention: str = "sql") -> DataFrame:
    """K2 again, as a join against the five-row rule table instead of a CASE chain.

    The rule table is a constant of five rows, so broadcasting it is safe at any
    data size. Used by the invariant tests; both forms must agree."""
    spark = df.sparkSession
    rules = spark.createDataFrame(
        [(p, Decimal(f), Decimal(o), u) for p, f, o, u, _ in PROMO_RULES],
        "rule_promo string, price_factor decimal(4,2), price_offset decimal(6,0), unit_factor int")
    j = df.join(F.broadcast(rules), F.col(PROMO_COL) == F.col("rule_promo"), "left")
    value = ((F.col(PRICE_COL) * F.col("price_factor") - F.col("price_offset"))
             * F.col(QTY_AFTER) * F.col("unit_factor")).cast(MONEY)
    if convention == "r":
        value = F.coalesce(value, F.lit(Decimal(0)).cast(MONEY))
    return j.withColumn("revenue_after_promo", value).drop("rule_promo", "price_factor",
                                                            "price_offset", "unit_factor")


def sold_units_after(qty=QTY_AFTER, promo=PROMO_COL, convention: str = "sql",
                     collation: str | None = None) -> Column:
    """K4: units after promo, BOGOF counting the free unit."""
    assert convention in CONVENTIONS
    qty = _col(qty)
    doubled = F.when(promo_is(promo, BOGOF, collation), qty * 2).otherwise(qty)
    if convention == "r":
        return F.when(_col(promo).isNull(), F.lit(None).cast("bigint")).otherwise(doubled)
    return doubled


def price_cents(price=PRICE_COL) -> Column:
    """DECIMAL(12,2) price as exact BIGINT cents. The double nearest a
    two-decimal price times 100 is within 2^-52 relative of the integer, so
    rounding it is exact for any DECIMAL(12,2)."""
    return F.floor(_col(price).cast("double") * F.lit(100.0) + F.lit(0.5)).cast("bigint")


#: Up to so many units, any DECIMAL(12,2) price times any rule stays inside a BIGINT of 1/10000 units.
SAFE_UNITS = 46_000


def _times_units(rate: Column, qty: Column) -> Column:
    """``rate`` (1/10000 units a piece, at most 2e14) times ``qty`` as DECIMAL(38,0): BIGINT arithmetic where that
    cannot overflow, DECIMAL arithmetic for larger quantities."""
    wide = rate.cast("decimal(18,0)") * qty.cast("decimal(19,0)")
    return F.when(F.abs(qty) <= SAFE_UNITS, (rate * qty).cast("decimal(38,0)")).otherwise(wide.cast("decimal(38,0)"))


def revenue_before_e4(price=PRICE_COL, qty=QTY_BEFORE) -> Column:
    """K1 in 1/10000 units."""
    return _times_units(price_cents(price) * F.lit(100), _col(qty))


def after_rate(cents: Column, promo=PROMO_COL, convention: str = "sql", collation: str | None = None) -> Column:
    """1/10000 units a piece after promo: (cents x factor% - offset cents x 100) x unit factor."""
    assert convention in CONVENTIONS
    expr = None
    for label, factor, offset, unit_factor, _ in PROMO_RULES:
        f100, off100 = int(Decimal(factor) * 100), int(Decimal(offset) * 100)
        value = cents * F.lit(f100)
        if off100:
            value = value - F.lit(off100 * 100)
        if unit_factor != 1:
            value = value * F.lit(unit_factor)
        cond = promo_is(promo, label, collation)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(F.lit(0).cast("bigint")) if convention == "r" else expr


def revenue_after_e4(price=PRICE_COL, qty=QTY_AFTER, promo=PROMO_COL,
                     convention: str = "sql", collation: str | None = None) -> Column:
    """K2 in 1/10000 units. Names its rate twice (see ``with_kpi_units`` for a form that computes it once)."""
    return _times_units(after_rate(price_cents(price), promo, convention, collation), _col(qty))


def e4_to_money(units: Column) -> Column:
    """Exact DECIMAL amount from a (summed) 1/10000 unit count."""
    return (units.cast("decimal(38,0)") * F.lit(Decimal("0.0001"))).cast("decimal(38,4)")


def e4_to_double(units: Column) -> Column:
    """The double nearest the amount: one correctly rounded division."""
    return units.cast("double") / F.lit(float(E4))


def incremental_sold_units(units_after, qty_before=QTY_BEFORE) -> Column:
    """K5: units after promo minus units before."""
    return _col(units_after) - _col(qty_before)


def incremental_revenue(rev_after="revenue_after_promo", rev_before="revenue_before_promo") -> Column:
    """K3: revenue after minus revenue before, per row."""
    return (_col(rev_after) - _col(rev_before)).cast(MONEY)


def margin_per_unit(rev_after_e4="revenue_after_e4", qty=QTY_AFTER) -> Column:
    """K8: revenue after promo over raw units after promo (an approximation in the
    source: not doubled for BOGOF). NULL when there are no units, like R's NaN
    that ``mean(na.rm=TRUE)`` drops."""
    return F.try_divide(e4_to_double(_col(rev_after_e4)), _col(qty).cast("double"))


def promo_in(promo, labels, collation: str | None = None) -> Column:
    """Membership that is false, not NULL, for a NULL promo."""
    p = F.collate(_col(promo), collation) if collation else _col(promo)
    return F.coalesce(p.isin(*labels), F.lit(False))


def discount_depth(promo=PROMO_COL, collation: str | None = None) -> Column:
    """K9: margin-loss class per promo; NULL for NULL or unknown promos."""
    expr = F.lit(None).cast("string")
    for depth in dict.fromkeys(rule[-1] for rule in PROMO_RULES):
        labels = [rule[0] for rule in PROMO_RULES if rule[-1] == depth]
        expr = F.when(promo_in(promo, labels, collation), F.lit(depth)).otherwise(expr)
    return expr


def with_kpis(df: DataFrame, convention: str = "r", collation: str | None = None) -> DataFrame:
    """R2: add K1, K2, K4, K5 (the state of the R pipeline after its unit step)."""
    return (df.withColumns({
        "revenue_before_promo": revenue_before(),
        "revenue_after_promo": revenue_after(convention=convention, collation=collation),
        "sold_units_after_promo": sold_units_after(convention=convention, collation=collation),
    }).withColumn("incremental_sold_units", incremental_sold_units("sold_units_after_promo")))


def with_kpi_units(df: DataFrame, convention: str = "r", collation: str | None = None) -> DataFrame:
    """The aggregation form of K1-K5, K3, K8: money as ``*_e4`` columns. Cents and rate are columns of a projection
    below, so that neither is computed more than once a row."""
    rated = df.withColumn("_cents", price_cents()).withColumn("_rate", after_rate(F.col("_cents"), convention=convention, collation=collation))
    return rated.withColumns({
        "revenue_before_e4": _times_units(F.col("_cents") * F.lit(100), _col(QTY_BEFORE)),
        "revenue_after_e4": _times_units(F.col("_rate"), _col(QTY_AFTER)),
        "sold_units_after_promo": sold_units_after(convention=convention, collation=collation),
    }).withColumns({
        "incremental_sold_units": incremental_sold_units("sold_units_after_promo"),
        "incremental_revenue_e4": F.col("revenue_after_e4") - F.col("revenue_before_e4"),
        "margin_per_unit": margin_per_unit(),
    }).drop("_cents", "_rate")


def with_unit_kpis(df: DataFrame, convention: str = "r", collation: str | None = None) -> DataFrame:
    """K4 and K5 alone: for reports that read no price."""
    units = sold_units_after(convention=convention, collation=collation)
    return (df.withColumn("sold_units_after_promo", units)
            .withColumn("incremental_sold_units", incremental_sold_units("sold_units_after_promo")))


def with_metric_evaluation(kpi_df: DataFrame, collation: str | None = None,
                           convention: str = "r") -> DataFrame:
    """Add K3, K8, K9 to a KPI fact. K8 divides the revenue that the fact already has (an exact DECIMAL, whose
    nearest double is that of its 1/10000 units), so the pricing rules are not evaluated again."""
    return kpi_df.withColumns({
        "incremental_revenue": incremental_revenue(),
        "margin_per_unit": F.try_divide(F.col("revenue_after_promo").cast("double"), F.col(QTY_AFTER).cast("double")),
        "discount_depth": discount_depth(collation=collation),
    })
