import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The fixtures are tiny: two shuffle partitions save most of each test's time."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
