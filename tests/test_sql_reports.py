"""Q1-Q5 as Spark SQL text agree with the DataFrame plans on edge-case rows."""

from promoscope.plans import reports as R
from promoscope.plans import sql_reports as SQL
from promoscope.plans.catalog import present
from tests.conftest import make_star


def _rows(df):
    return sorted((tuple(r) for r in present(df).collect()), key=str)


def test_sql_text_equals_dataframe_plans(spark):
    star = make_star(spark, [
        ("e1", "S1", "C1", "P1", 990, "BOGOF", 10, 20),
        ("e2", "S2", "C1", "P2", 120, "500 Cashback", 5, 0),
        ("e3", "S3", "C2", "P3", 960, "BOGOF", 0, 7),
        ("e4", "S1", "C2", "P1", 55.55, None, 4, 4),
        ("e5", "S2", "C1", "P2", 10, "10% OFF", 3, 9),
        ("e6", "S9", "C9", "P9", 999, "BOGOF", 1, 1),       # orphan keys: dropped by inner joins
    ])
    pairs = [
        (R.q1_high_value_bogof(star, 950), SQL.q1_sql(star, 950)),
        (R.q2_stores_by_city(star), SQL.q2_sql(star)),
        (R.q3_campaign_revenue(star), SQL.q3_sql(star)),
        (R.q4_campaign_isu_rank(star, "Tulip Week"), SQL.q4_sql(star, "Tulip Week")),
        (R.q5_top5_products_ir(star, 2), SQL.q5_sql(star, 2)),
    ]
    for i, (a, b) in enumerate(pairs, 1):
        assert a.columns == b.columns, i
        assert _rows(a) == _rows(b), i
