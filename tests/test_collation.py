"""reports over normalised texts equal the same reports under the collation itself."""

import random

import pytest
from pyspark.sql import functions as F

from promoscope.operators.collation import LABELS, exceptions, normalised
from promoscope.plans import reports as R
from promoscope.sources.star import RetailStar
from tests.conftest import make_star


def _vary(rng, text):
    return "".join(rng.choice([c.lower(), c.upper(), c]) for c in text).replace("e", rng.choice(["e", "é"]))


def _star(spark, seed=1):
    rng = random.Random(seed)
    promos = [*LABELS, "Mystery Deal", None]
    fact = []
    for i in range(300):
        promo = rng.choice(promos)
        fact.append((f"e{i}", _vary(rng, f"st{i % 7}"), _vary(rng, f"ce{i % 3}"), _vary(rng, f"pé{i % 9}"), 400 + 60 * (i % 9),
                     promo and _vary(rng, promo), rng.randint(0, 40), rng.randint(0, 40)))
    import datetime as dt
    camps = [(f"CE{i}", n, dt.date(2031, 4, 3), dt.date(2031, 4, 9)) for i, n in enumerate(["Tulip Week", "TULIP WEEK", "Cider Days"])]
    prods = [(f"Pe{i}", rng.choice(["Café Mug", "CAFE MUG", "Lamp"]), rng.choice(["Home", "HOME", "Höme", "Garden"])) for i in range(9)]
    stores = [(f"ST{i}", rng.choice(["Riverton", "RIVERTON", "Lakeside"])) for i in range(7)]
    return make_star(spark, fact, camps, prods, stores)


REPORTS = [lambda s: R.q1_high_value_bogof(s), lambda s: R.q1_high_value_bogof(s, 0, "bogof"), lambda s: R.q1_high_value_bogof(s, 0, "mystery DEAL"),
           R.q2_stores_by_city, R.q3_campaign_revenue, lambda s: R.q4_campaign_isu_rank(s, "tulip week"), R.q5_top5_products_ir]


@pytest.mark.parametrize("k", range(len(REPORTS)))
def test_reports_equal_those_under_the_collation(spark, k):
    """Which text of a class is shown is free: texts are compared without case and accents."""
    star = _star(spark)
    plain = {"é": "e", "ö": "o"}
    fold = lambda v: "".join(plain.get(c, c) for c in v.lower()) if isinstance(v, str) else v
    rows = lambda df: sorted((tuple(fold(v) for v in r) for r in df.collect()), key=str)
    assert rows(REPORTS[k](normalised(star))) == rows(REPORTS[k](star.collated())) != []


def test_only_exceptions_are_kept_and_labels_stand_for_their_class(spark):
    star = _star(spark)
    tables = [star.unit_events, star.dim_campaigns, star.dim_products, star.dim_stores]
    rows = exceptions(tables, "UNICODE_CI_AI").collect()
    assert {r.instead for r in rows if r.domain == "promo_type"} <= {*LABELS, *(r.instead for r in rows if r.instead.lower() == "mystery deal")}
    assert all(r.value != r.instead for r in rows) and len({(r.domain, r.value) for r in rows}) == len(rows)
    assert not any(r.domain == "event_id" for r in rows)


def test_plans_hash_and_untouched_columns(spark):
    star = _star(spark)
    plan = R.q5_top5_products_ir(normalised(star))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "SortMergeJoin" not in plan
    clean = make_star(spark, [("a", "S1", "C1", "P1", 10, "BOGOF", 1, 2)])
    same = normalised(clean)
    assert "Join" not in same.fact_events._jdf.queryExecution().optimizedPlan().toString()
    assert same.fact_events.collect() == clean.fact_events.collect()


def test_empty_star(spark):
    star = make_star(spark, [], [], [], [])
    assert R.q3_campaign_revenue(normalised(star)).collect() == []
    assert isinstance(normalised(star), RetailStar) and normalised(star).fact_events.columns == star.fact_events.columns


def test_null_texts_stay_null(spark):
    star = make_star(spark, [("a", None, "c1", "P1", 10, None, 1, 2), ("b", "S1", "C1", "p1", 10, "bogof", 1, 2)])
    got = {r.event_id: r for r in normalised(star).fact_events.collect()}
    assert got["a"].store_id is None and got["a"].promo_type is None and got["b"].promo_type == "BOGOF"
    assert got["a"].campaign_id == "C1" and normalised(star).fact_events.filter(F.col("product_code") == "P1").count() == 2
