"""KPI truth table and the edge fixtures of FIXTURES.md §2 (invented rows)."""

from decimal import Decimal

from pyspark.sql import functions as F

from promoscope.functions import kpi
from promoscope.plans import reports as R
from tests.conftest import make_star


def _rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def test_truth_table_sql_and_r(spark):
    star = make_star(spark, [
        ("e1", "S1", "C1", "P1", 100, "BOGOF", 10, 20),
        ("e2", "S1", "C1", "P1", 100, "500 Cashback", 10, 20),
        ("e3", "S1", "C1", "P1", 100, "50% OFF", 10, 20),
        ("e4", "S1", "C1", "P1", 100, "33% OFF", 10, 20),
        ("e5", "S1", "C1", "P1", 100, "25% OFF", 10, 20),
        ("e6", "S1", "C1", "P1", 100, None, 10, 20),
        ("e7", "S1", "C1", "P1", 100, "10% OFF", 10, 20),
    ])
    f = star.fact_events
    sql = kpi.with_kpis(f, "sql").select("event_id", "revenue_after_promo", "sold_units_after_promo")
    r = kpi.with_kpis(f, "r").select("event_id", "revenue_after_promo", "sold_units_after_promo")
    got_sql = {x.event_id: (x.revenue_after_promo, x.sold_units_after_promo) for x in sql.collect()}
    got_r = {x.event_id: (x.revenue_after_promo, x.sold_units_after_promo) for x in r.collect()}
    assert got_sql["e1"] == (Decimal("2000.0000"), 40)
    assert got_sql["e2"] == (Decimal("-8000.0000"), 20)      # cheap_cashback: negative, not clamped
    assert got_sql["e3"] == (Decimal("1000.0000"), 20)
    assert got_sql["e4"] == (Decimal("1340.0000"), 20)
    assert got_sql["e5"] == (Decimal("1500.0000"), 20)
    assert got_sql["e6"] == (None, 20)                        # null_promo, SQL mode
    assert got_sql["e7"] == (None, 20)                        # unknown_promo, SQL mode
    assert got_r["e6"] == (Decimal("0.0000"), None)           # null_promo, R mode
    assert got_r["e7"] == (Decimal("0.0000"), 20)             # unknown_promo, R mode
    dd = {x.event_id: x.discount_depth for x in
          f.select("event_id", kpi.discount_depth().alias("discount_depth")).collect()}
    assert dd["e7"] is None and dd["e6"] is None and dd["e1"] == "Medium Margin Loss"


def test_integer_units_equal_decimal_form(spark):
    star = make_star(spark, [
        ("e1", "S1", "C1", "P1", 999.99, "33% OFF", 7, 13),
        ("e2", "S1", "C1", "P1", 120, "500 Cashback", 1, 3),
        ("e3", "S1", "C1", "P1", 0.01, "BOGOF", 5, 9),
        ("e4", "S1", "C1", "P1", 55.55, None, 5, 9)])
    for conv in ("sql", "r"):
        df = kpi.with_kpi_units(kpi.with_kpis(star.fact_events, conv), conv)
        for r in df.select(kpi.e4_to_money(F.col("revenue_after_e4")).alias("a"), "revenue_after_promo",
                           kpi.e4_to_money(F.col("revenue_before_e4")).alias("b"),
                           "revenue_before_promo").collect():
            assert r.a == r.revenue_after_promo and r.b == r.revenue_before_promo


def test_rule_table_equals_case_chain(spark):
    star = make_star(spark, [
        ("e1", "S1", "C1", "P1", 333.33, p, 3, 7) for p in
        ["BOGOF", "500 Cashback", "50% OFF", "33% OFF", "25% OFF", None, "bogof"]])
    for conv in ("sql", "r"):
        a = kpi.revenue_after_by_rule_table(star.fact_events, conv).select("event_id", "promo_type",
                                                                            "revenue_after_promo")
        b = star.fact_events.select("event_id", "promo_type",
                                    kpi.revenue_after(convention=conv).alias("revenue_after_promo"))
        assert _rows(a, "promo_type", "revenue_after_promo") == _rows(b, "promo_type", "revenue_after_promo")


def test_zero_after_and_zero_before(spark):
    star = make_star(spark, [
        ("e1", "S1", "C1", "P1", 100, "BOGOF", 0, 0),
        ("e2", "S2", "C1", "P2", 100, "BOGOF", 0, 5)])
    ev = R.metric_evaluation(star)
    m = {r.event_id: r.margin_per_unit for r in ev.collect()}
    assert m["e1"] is None and m["e2"] == 100.0
    # all before-quantities 0: IR% and ISU% NULL, no ANSI error
    assert R.overall_ir_pct(star).first()[0] is None
    assert R.overall_isu_pct(star).first()[0] is None
    q4 = R.q4_campaign_isu_rank(star, "Tulip Week").collect()
    assert all(r.ISU_Percent is None for r in q4)


def test_orphans_null_keys_and_dup_dims(spark):
    star = make_star(spark, [
        ("e1", "S9", "C9", "P9", 100, "BOGOF", 1, 2),          # orphan_keys
        ("e2", None, "C1", "P1", 100, "BOGOF", 1, 2),          # null_key on the fact
        ("e3", "S1", "C1", "P1", 100, "BOGOF", 1, 2)],
        stores=[("S1", "Riverton"), (None, "Nowhere"), ("S1", "Riverton")])   # null key + dup_dim
    left = R.enriched_fact(star)
    cities = sorted([(r.event_id, r.city) for r in left.collect()], key=str)
    # left join keeps the orphan with NULL attributes, matches NULL to NULL, duplicates S1
    assert cities == sorted([("e1", None), ("e2", "Nowhere"), ("e3", "Riverton"), ("e3", "Riverton")], key=str)
    # inner (SQL) join drops the orphan campaign/product rows
    q3 = R.q3_campaign_revenue(star).collect()
    assert [r.campaign_name for r in q3] == ["Tulip Week"]
    # pre-aggregated store report multiplies exactly like the row-level join
    top = {r.store_id: r.total_incremental_revenue for r in R.top10_stores_ir(star).collect()}
    row_level = (left.where(F.col("store_id") == "S1").count())
    assert row_level == 2 and top["S1"] == 2 * Decimal("100.0000")
    from promoscope.operators.quality import quality_checks
    qc = {r.check: r.violations for r in quality_checks(star).collect()}
    assert qc["dim_stores.store_id.duplicate_keys"] == 1
    assert qc["fact_events.store_id.orphans"] == 2        # S9 and the NULL key
    assert qc["fact_events.campaign_id.orphans"] == 1
    assert qc["fact_events.store_id.nulls"] == 1
    assert qc["dim_stores.store_id.nulls"] == 1


def test_single_row_group_and_medians(spark):
    star = make_star(spark, [
        ("e1", "S1", "C1", "P1", 100, "BOGOF", 10, 20),
        ("e2", "S1", "C1", "P1", 100, "50% OFF", 10, 20),
        ("e3", "S2", "C1", "P1", 100, "50% OFF", 10, 30),
        ("e4", "S3", "C1", "P1", 100, "50% OFF", 10, 41)])
    st = {r.promo_type: r for r in R.promo_isu_stats(star).collect()}
    assert st["BOGOF"].sd_incremental_sold_units is None
    assert st["BOGOF"].median_incremental_sold_units == 30.0
    assert st["50% OFF"].median_incremental_sold_units == 20.0
    assert abs(st["50% OFF"].sd_incremental_sold_units - 10.5039675) < 1e-6
    ir = {r.promo_type: r for r in R.promo_ir_stats(star).collect()}
    assert ir["50% OFF"].median_incremental_revenue == 500.0


def test_tie_at_k_and_rank_gap(spark):
    # five stores with equal IR at places 2..4: exactly k rows, chosen by key order
    rows = [(f"e{i}", s, "C1", "P1", 100, "BOGOF", 10, q) for i, (s, q) in
            enumerate([("S1", 30), ("S2", 20), ("S3", 20), ("S4", 20), ("S5", 10)])]
    star = make_star(spark, rows, stores=[(f"S{i}", "X") for i in range(1, 6)])
    top = [r.store_id for r in R.top10_stores_ir(star, k=3).collect()]
    assert top == ["S1", "S2", "S3"]
    # rounded_tie: equal after rounding to 2 -> equal rank, then a gap
    rows = [("a", "S1", "C1", "P1", 100, None, 3, 4), ("b", "S1", "C1", "P2", 100, None, 3000, 4000),
            ("c", "S1", "C1", "P3", 100, None, 3, 5)]
    star = make_star(spark, rows)
    rk = {r.category: (r.ISU_Percent, r.rank_order) for r in R.q4_campaign_isu_rank(star, "Tulip Week").collect()}
    assert rk["Lighting"] == (66.67, 1)
    assert rk["Pantry & Breakfast"] == (33.33, 2) and rk["Bath"] == (33.33, 2)


def test_r11_real_semantics_with_small_n(spark):
    rows = [(f"e{i}", "S1", "C1", "P1", 100, p, 10, q) for i, (p, q) in
            enumerate([("BOGOF", 30), ("50% OFF", 40), ("25% OFF", 10)])]
    star = make_star(spark, rows)
    got = [(r.store_id, r.promo_type) for r in R.top_stores_by_promo(star, n=2).collect()]
    assert sorted(got) == [("S1", "50% OFF"), ("S1", "BOGOF")]
    assert R.top_stores_by_promo(star, n=10).count() == 3


def test_same_name_two_codes(spark):
    star = make_star(spark, [("a", "S1", "C1", "P1", 10, "BOGOF", 1, 2), ("b", "S1", "C1", "P2", 10, "BOGOF", 1, 2)],
                     products=[("P1", "Twin", "Cat"), ("P2", "Twin", "Cat")])
    assert R.product_lift(star).count() == 2
    assert R.product_before_after(star).count() == 2      # one name x two sale types


def test_damaged_event_id_and_case_variants(spark):
    star = make_star(spark, [("7.5E+08", "S1", "C1", "P1", 10, "bogof", 1, 2),
                             ("0012", "S1", "C1", "P1", 10, "BOGOF", 1, 2),
                             ("4711", "S1", "C1", "P1", 10, "BOGOF", 1, 2)])
    ids = sorted(r.event_id for r in R.enriched_fact(star).collect())
    assert ids == ["0012", "4711", "7.5E+08"]
    binary = star.fact_events.where(kpi.promo_is(F.col("promo_type"), "BOGOF")).count()
    collated = star.fact_events.where(kpi.promo_is(F.col("promo_type"), "BOGOF", "UNICODE_CI_AI")).count()
    assert binary == 2 and collated == 3


def test_label_format(spark):
    from promoscope.functions.labels import millions_label, thousands_label
    df = spark.createDataFrame([(Decimal("82500000.0000"),), (Decimal("1234567.2500"),),
                                (Decimal("-1234567.2500"),), (Decimal("0"),), (Decimal("4999.9999"),)],
                               "x decimal(24,4)")
    got = [(r.m, r.k) for r in df.select(millions_label(F.col("x")).alias("m"),
                                          thousands_label(F.col("x")).alias("k")).collect()]
    assert got[0] == ("82.50M", "₹82,500.0K")
    assert got[1] == ("1.23M", "₹1,234.6K")
    assert got[2] == ("-1.23M", "₹-1,234.6K")
    assert got[3] == ("0.00M", "₹0.0K")
    assert got[4] == ("0.00M", "₹5.0K")


def test_scalar_attach_then_drop_gives_kpi_fact(spark):
    # R4 then P3: every row carries the global IR%, and dropping it restores R2
    star = make_star(spark, [("a", "S1", "C1", "P1", 10, "BOGOF", 1, 2), ("b", "S2", "C2", "P2", 10, None, 3, 4)])
    with_ir = R.enrich_with_overall_ir(star)
    assert {r.IR_Percentage for r in with_ir.collect()} == {R.overall_ir_pct(star).first()[0]}
    dropped = with_ir.drop("IR_Percentage")
    assert dropped.columns == R.kpi_fact(star).columns
    assert sorted(map(tuple, dropped.collect())) == sorted(map(tuple, R.kpi_fact(star).collect()))
