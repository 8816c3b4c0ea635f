import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from promoscope.session import get_session, release
    s = get_session(master="local[*]", shuffle_partitions=8, extra={"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield s
    release(s)
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


def make_star(spark, fact_rows, campaigns=None, products=None, stores=None):
    """A tiny invented star (FIXTURES §2). Rows are tuples in schema order."""
    from promoscope import schemas
    from promoscope.sources.star import RetailStar
    import datetime as dt
    from decimal import Decimal
    fact = [(e, s, c, p, Decimal(str(price)), promo, qb, qa)
            for e, s, c, p, price, promo, qb, qa in fact_rows]
    campaigns = campaigns if campaigns is not None else [
        ("C1", "Tulip Week", dt.date(2031, 4, 3), dt.date(2031, 4, 9)),
        ("C2", "Cider Days", dt.date(2032, 10, 21), dt.date(2032, 10, 30))]
    products = products if products is not None else [
        ("P1", "Oat Flakes (1KG)", "Pantry & Breakfast"), ("P2", "Lemon Soap", "Bath"),
        ("P3", "Desk Lamp", "Lighting")]
    stores = stores if stores is not None else [("S1", "Riverton"), ("S2", "Lakeside"), ("S3", "Lakeside")]
    nullable = lambda schema: schema.__class__([f.__class__(f.name, f.dataType, True) for f in schema.fields])
    return RetailStar(
        spark.createDataFrame(fact, nullable(schemas.FACT_EVENTS)),
        spark.createDataFrame(campaigns, nullable(schemas.DIM_CAMPAIGNS)),
        spark.createDataFrame(products, nullable(schemas.DIM_PRODUCTS)),
        spark.createDataFrame(stores, nullable(schemas.DIM_STORES)))
