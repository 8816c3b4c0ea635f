"""Loaders: typed CSV/Parquet scans, SQL-dump tuple text, and the adapter that
presents the driver's TPC-H-like tables as the retail star."""

from promoscope.sources.star import RetailStar
from promoscope.sources.layout import read_bucketed_star, write_bucketed_star, write_parquet_star
from promoscope.sources.retail import (
    read_csv_typed, read_parquet_star, read_insert_tuples, write_insert_tuples,
    write_csv_star, write_report, read_sql_dump_star,
)
from promoscope.sources.testdata_star import testdata_star

__all__ = [
    "RetailStar", "write_parquet_star", "read_bucketed_star", "write_bucketed_star", "read_csv_typed", "read_parquet_star", "read_insert_tuples",
    "write_insert_tuples", "write_csv_star", "write_report", "read_sql_dump_star", "testdata_star",
]
