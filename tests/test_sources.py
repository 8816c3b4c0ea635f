"""Loaders: tuple text (S5), typed CSV with day-first dates."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from promoscope import schemas
from promoscope.sources.retail import read_csv_typed, read_insert_tuples, write_insert_tuples


def _tmp():
    return tempfile.mkdtemp(prefix="promoscope-test-", dir="/tmp")


TUPLES = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])


def _rows(spark, text):
    d = _tmp()
    with open(os.path.join(d, "dump.sql"), "w") as fh:
        fh.write(text)
    return sorted((tuple(r) for r in read_insert_tuples(spark, d, TUPLES, table="t").collect()), key=str)


def test_dump_statements(spark):
    """Statements over lines, spaces between tuples, column lists, both escapes, quoted NULL, any case, IGNORE."""
    text = """-- don't
CREATE TABLE `t` (a varchar(10), n int(11));
INSERT INTO `t` VALUES ('a','x (1KG), y',1),('b','c',NULL),('c','it\\'s',3), ('d','),(',4)
 ,('e','it''s; ok\\nnew',12.0);
insert ignore into t (b,a,n) values ('B','A',5);
INSERT INTO `t` (`n`, `a`) VALUES (8,'only two');
INSERT INTO `u` VALUES ('zz','INSERT INTO `t` VALUES (1,2,3);',9);
INSERT INTO `t` VALUES ('f','NULL',-6),('g',null,7);
UNLOCK TABLES;
"""
    want = sorted([("a", "x (1KG), y", 1), ("b", "c", None), ("c", "it's", 3), ("d", "),(", 4), ("e", "it's; ok\nnew", 12), ("A", "B", 5),
                   ("only two", None, 8), ("f", "NULL", -6), ("g", None, 7)], key=str)
    assert _rows(spark, text) == want


def test_dump_values_with_raw_line_breaks(spark):
    assert _rows(spark, "INSERT INTO t VALUES ('a','x\ny',1),('b','pq',2);\n") == [("a", "x\ny", 1), ("b", "pq", 2)]
    assert _rows(spark, "INSERT INTO t VALUES ('a','x\ny',1),('b','p;\nq',2);\n") == [("a", "x\ny", 1), ("b", "p;\nq", 2)]


def test_dump_one_giant_statement(spark):
    text = "-- h\nCREATE TABLE `t` (a varchar(10));\nINSERT INTO `t` VALUES ('a','x),(y',1),('b','c\nd',NULL);\nINSERT INTO `t` VALUES ('d','e',4);\nUNLOCK TABLES;\n"
    assert _rows(spark, text) == [("a", "x),(y", 1), ("b", "c\nd", None), ("d", "e", 4)]


@pytest.mark.parametrize("text", ["INSERT INTO t VALUES ('a','x');\n", "INSERT INTO t VALUES ('a','x','abc');\n", "INSERT INTO t VALUES ('a','x',1), ('b','y'",
                                  "INSERT INTO t VALUES ('a','x',(1));\n", "INSERT INTO t VALUES ROW('a','x',1);\n", "INSERT INTO t (a, b, n) VALUE S('a','x',1);\n",
                                  "INSERT INTO t VALUES ('a', x'ab', 1);\n"])
def test_dump_that_does_not_parse_raises(spark, text):
    with pytest.raises(Exception, match="not a row|cannot hold|does not parse"):
        _rows(spark, text)


def test_dump_round_trip(spark):
    rows = [("a\nb", "c'd\\e", 1), ("\\n", "),(;\n", 2), (None, "NULL", None), ("é 😀", "\t\x1a\x00|", -3), ("", ";", 4), ("''", "\\'", 5), ("x" * 5000, "(((", 6)]
    d = _tmp()
    write_insert_tuples(spark.createDataFrame(rows, TUPLES), d, "t")
    assert sorted((tuple(r) for r in read_insert_tuples(spark, d, TUPLES, table="t").collect()), key=str) == sorted(rows, key=str)


def test_csv_reading_rules(spark):
    d = _tmp()
    with open(os.path.join(d, "x.csv"), "w") as fh:
        fh.write('a,b,n\n" BOGOF ","Pan ""6 inch""",12.0\nNA,"two\nlines",x\n,NA,1.5\n"p,q",r,1e3\n')
    got = sorted((tuple(r) for r in read_csv_typed(spark, d, TUPLES, unparsed="bad").collect()), key=str)
    assert got == sorted([("BOGOF", 'Pan "6 inch"', 12, 0), ("p,q", "r", 1000, 0), (None, "two\nlines", None, 1), (None, None, None, 1)], key=str)


def test_csv_day_first_dates_and_raw_headers(spark):
    d = _tmp()
    with open(os.path.join(d, "c.csv"), "w") as fh:
        fh.write("campaign_id,campaign_name,start_date,end_date\r\nK-01,Tulip Week,03-04-2031,09-04-2031\r\n"
                 "K-99,Bad,31-02-2031,01-03-2031\r\n")
    df = read_csv_typed(spark, d, schemas.DIM_CAMPAIGNS)
    rows = {r.campaign_id: r for r in df.collect()}
    assert str(rows["K-01"].start_date) == "2031-04-03"
    assert rows["K-99"].start_date is None            # invalid date -> NULL, not an error
    f = _tmp()
    with open(os.path.join(f, "f.csv"), "w") as fh:
        fh.write("event_id,store_id,campaign_id,product_code,base_price,promo_type,"
                 "quantity_sold(before_promo),quantity_sold(after_promo)\n"
                 "7.5E+08,ST-7,K-02,X4,61.5,33% OFF,27,1040\n0012,ST-7,K-02,X4,61.5,,1,2\n")
    fact = read_csv_typed(spark, f, schemas.FACT_EVENTS)
    got = {r.event_id: r for r in fact.collect()}
    assert set(got) == {"7.5E+08", "0012"}
    assert got["7.5E+08"].quantity_sold_before_promo == 27
    assert got["0012"].promo_type is None
    assert fact.schema["base_price"].dataType == schemas.PRICE


def test_write_report_partitioned_round_trip(spark, tmp_path):
    from promoscope.sources.retail import write_report
    from tests.conftest import make_star
    star = make_star(spark, [("a", "S1", "C1", "P1", 10, "BOGOF", 1, 2), ("b", "S2", "C2", "P2", 10, None, 3, 4)])
    path = str(tmp_path / "fact")
    write_report(star.fact_events, path, partition_by="campaign_id")
    back = spark.read.parquet(path)
    assert sorted(r.event_id for r in back.where("campaign_id = 'C2'").collect()) == ["b"]
    plan = back.where("campaign_id = 'C2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(campaign_id" in plan


def test_multi_table_dump_to_star(spark):
    """An invented dump in mysqldump layout: four tables, DDL, locks, one INSERT line each."""
    from promoscope.plans import reports as R
    from promoscope.sources.retail import read_sql_dump_star
    d = _tmp()
    text = """-- dump
DROP TABLE IF EXISTS `dim_campaigns`;
CREATE TABLE `dim_campaigns` (
  `campaign_id` varchar(20) NOT NULL,
  PRIMARY KEY (`campaign_id`)
) ENGINE=InnoDB;
LOCK TABLES `dim_campaigns` WRITE;
INSERT INTO `dim_campaigns` VALUES ('K1','Tulip Week','2031-04-03','2031-04-09'),('K2','Cider Days','2032-10-21','2032-10-30');
UNLOCK TABLES;
INSERT INTO `dim_products` VALUES ('X1','Oat Flakes (1KG)','Pantry & Breakfast'),('X2','Lamp, Desk','Lighting');
INSERT INTO `dim_stores` VALUES ('ST-1','Riverton'),('ST-2','Lakeside');
INSERT INTO `fact_events` VALUES ('7.5E+08','ST-1','K1','X1',190,'BOGOF',10,20),('0012','ST-2','K2','X2',120,'500 Cashback',5,6),('4711','ST-2','K1','X2',300,NULL,7,8);
"""
    with open(os.path.join(d, "dump.sql"), "w") as fh:
        fh.write(text)
    star = read_sql_dump_star(spark, d)
    assert star.dim_products.count() == 2 and star.dim_stores.count() == 2
    fact = {r.event_id: r for r in star.fact_events.collect()}
    assert set(fact) == {"7.5E+08", "0012", "4711"}
    assert fact["4711"].promo_type is None and fact["0012"].quantity_sold_after_promo == 6
    assert str(fact["7.5E+08"].base_price) == "190.00"
    assert {r.product_name for r in star.dim_products.collect()} == {"Oat Flakes (1KG)", "Lamp, Desk"}
    q3 = {r.campaign_name: r.total_revenue_before_promotion for r in R.q3_campaign_revenue(star).collect()}
    assert q3 == {"Tulip Week": "0.00M", "Cider Days": "0.00M"}
    ir = {r.promo_type: r.total_incremental_revenue for r in R.promo_ir(star).collect()}
    assert str(ir["BOGOF"]) == "1900.0000"
