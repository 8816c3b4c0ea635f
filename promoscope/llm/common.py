"""Helpers shared by the operators: tables, written intermediates, row splits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_remainder(col: str | Column, mod: int) -> Column:
    """``crc32`` of the value as text, modulo ``mod`` (NULL counts as the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def row_pieces(batch: pa.RecordBatch, text: str, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in turn, about ``chars`` of text at a time (one long text stays whole)."""
    size = np.array(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    if not len(size):
        yield batch
        return
    owner = np.cumsum(size) // chars
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


class Scratch:
    """Intermediate tables in the shared folder of ``spark.checkpoint.dir``.

    ``write`` runs a plan once and returns a DataFrame that reads the written
    table, which cuts the lineage; ``drop`` deletes a table that no later plan
    reads. A table that a returned lazy result reads stays until the
    application's checkpoint folder is cleared.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, rows: int | None = None, each: int = 50_000) -> DataFrame:
        """``rows``: how many the table has at most, where that is known; it is then written by one task for
        ``each`` of them instead of one for every shuffle partition."""
        path = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // each)))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
