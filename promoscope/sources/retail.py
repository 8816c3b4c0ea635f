"""Loaders for the retail star (S1-S5, S7) and the sinks used to round-trip it.

* ``read_csv_typed``: header CSV, every field read as text, then cast to the
  declared schema (S1/S4); day-first dates parsed with ``try_to_date`` (S2);
  the raw quantity headers renamed (S7). Text is trimmed, empty text and ``NA``
  are NULL, quotes are doubled inside quotes, and quoted line breaks are kept.
* ``read_insert_tuples`` / ``read_sql_dump_star``: rows carried as SQL
  ``INSERT ... VALUES (..),(..);`` text (S5), e.g. a whole MySQL dump. Column
  lists, both ways of escaping, ``IGNORE``, comments and any case are honoured.
  What claims to be rows of the table and does not parse raises an error: no row
  is lost or bent silently.

Both read files of any size in parallel byte ranges, whatever stands inside quotes
(``spans``): a statement or a record may cross ranges.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope import schemas
from promoscope.sources import dump, layout, spans
from promoscope.sources.layout import read_parquet_star  # noqa: F401
from promoscope.sources.star import RetailStar

DAY_FIRST = "dd-MM-yyyy"


def _whole_number(c: Column) -> Column:
    """Text of a whole number, also written as ``12.0`` or ``1.2e1``, as BIGINT (else NULL)."""
    wide = c.try_cast("decimal(38,10)")
    return F.coalesce(c.try_cast("bigint"), F.when(wide == F.floor(wide), wide.try_cast("bigint")),
                      F.when(wide.isNull() & (c.try_cast("double") == F.floor(c.try_cast("double"))), c.try_cast("double").try_cast("bigint")))


#: Complete fields, then a quoted one that the line does not close.
_OPEN_FIELD = r'(?s)^(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+,|[^",][^,]*+,|,)*+"[^"]*+(?:""[^"]*+)*+\z'
_SPACE = " \t\n\x0b\x0c\r"


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any quoted field of CSV files holds a line break: one pass over their lines."""
    value = F.col("value")
    open_field = F.when(value.contains('"'), value.rlike(_OPEN_FIELD)).otherwise(F.lit(False))
    return bool(spans.pieces(spark, path, "\n").agg(F.bool_or(open_field)).first()[0])


def _csv_records(header: list[str]):
    def emit(block: int, known: str | None, records: Iterator[str]) -> Iterator[pa.RecordBatch]:
        some = []
        for k, record in enumerate(records):
            record = record.removesuffix("\r")
            if k == 0 and block == 0:
                names = next(csv.reader([record.removeprefix("\ufeff")]), [])
                if names != header:
                    raise ValueError(f"files with other headers: {names} and {header}")
            elif record.strip():
                some.append(record)
            if len(some) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["record"])
                some = []
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["record"])

    return emit


def _raw_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The files' fields as texts, under the header's names."""
    how = {"quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE"}
    plain = spark.read.options(header=True, inferSchema=False, multiLine=False, **how).csv(path)
    if not multi_line:
        return plain
    header = plain.columns
    records = spans.cut_records(spark, path, spans.Cutter(), _csv_records(header), "record string")
    ddl = ", ".join(f"c{i} STRING" for i in range(len(header)))
    parsed = records.select(F.from_csv("record", ddl, {**how, "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(header)])


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, renames: dict[str, str] | None = None,
                   date_format: str = DAY_FIRST, na: tuple[str, ...] = ("", "NA"), trim: bool = True,
                   multi_line: bool | None = None, unparsed: str | None = None) -> DataFrame:
    """S1. ``na``: texts that stand for NULL. ``multi_line``: whether quoted fields hold line breaks; if it is not given,
    one pass over the files finds out. Files with such fields are cut at their true records by many tasks (``spans``),
    others are read by the plain reader. ``unparsed`` names an extra column with the number of the row's fields that
    held something and could not be read as their type (they are NULL)."""
    raw = _raw_csv(spark, path, has_line_breaks(spark, path) if multi_line is None else multi_line)
    ren = dict(schemas.RAW_QTY_RENAMES)
    ren.update(renames or {})
    raw = raw.withColumnsRenamed({k: v for k, v in ren.items() if k in raw.columns})

    def text(name: str) -> Column:
        c = F.col(f"`{name}`")
        c = F.btrim(c, F.lit(_SPACE)) if trim else c
        return F.when(~c.isin(*na), c)

    # texts first, as a projection of their own: a cast reads its text more than once
    raw = raw.select(*[text(f.name).alias(f.name) for f in schema.fields])
    cols, lost = [], F.lit(0)
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cols.append(c)
            continue
        if isinstance(f.dataType, T.DateType):
            value = F.try_to_date(c, date_format)
        elif isinstance(f.dataType, T.IntegralType):
            value = _whole_number(c).try_cast(f.dataType)
        else:
            value = c.try_cast(f.dataType)
        cols.append(value.alias(f.name))
        lost = lost + (c.isNotNull() & value.isNull()).cast("int")
    return raw.select(*cols, *([lost.alias(unparsed)] if unparsed else []))


def write_csv_star(star: RetailStar, root: str, date_format: str = DAY_FIRST,
                   tables=("fact_events", "dim_campaigns", "dim_products", "dim_stores")) -> None:
    """CSV copy of the star in the shipped layout: day-first dates and the raw
    quantity headers. Written in parallel, one folder per table."""
    back = {v: k for k, v in schemas.RAW_QTY_RENAMES.items()}
    for name in tables:
        df = getattr(star, name)
        df = df.select(*[
            F.date_format(F.col(c), date_format).alias(c) if isinstance(df.schema[c].dataType, T.DateType)
            else F.col(c).alias(back.get(c, c)) for c in df.columns])
        df.write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/{name}")


def read_insert_tuples(spark: SparkSession, path: str, schema: T.StructType, table: str | None = None) -> DataFrame:
    """Rows of ``table`` (of all tables, if not given) from SQL ``INSERT ... VALUES (..),(..);`` text (S5); columns a
    statement's list leaves out are NULL.

    Files are read in byte ranges by many tasks, whatever the size of a file or of a statement, and whatever a quoted
    text holds: parentheses, commas, semicolons, raw line breaks. Only a single row has to fit in memory. If a file is
    read in more than one range, two short jobs run while the plan is built (``spans``)."""
    emit = dump.emitter(schema.names, table)
    rows = spans.cut_records(spark, path, spans.SqlCutter(), emit, "fields array<string>", told=dump.Sum, context=dump.contexts)
    cols = []
    for i, f in enumerate(schema.fields):
        text = F.get("fields", F.lit(i))
        if isinstance(f.dataType, T.StringType):
            cols.append(text.alias(f.name))
            continue
        plain = F.trim(text)
        value = _whole_number(plain).try_cast(f.dataType) if isinstance(f.dataType, T.IntegralType) else plain.try_cast(f.dataType)
        bad = F.raise_error(F.concat(F.lit(f"column {f.name} cannot hold: "), F.substring(text, 1, 100)))
        cols.append(F.when(text.isNotNull() & value.isNull(), bad.cast(f.dataType)).otherwise(value).alias(f.name))
    return rows.select(*cols)


def read_sql_dump_star(spark: SparkSession, path: str) -> RetailStar:
    """The four retail tables from one SQL dump (S5 + S4 + S7): each table's
    statements parsed with its declared schema, by their column lists or in the
    declared order."""
    def load(name, schema):
        return read_insert_tuples(spark, path, schema, table=name)
    return RetailStar(load("fact_events", schemas.FACT_EVENTS), load("dim_campaigns", schemas.DIM_CAMPAIGNS),
                      load("dim_products", schemas.DIM_PRODUCTS), load("dim_stores", schemas.DIM_STORES))


def _sql_literal(c: str, dt: T.DataType) -> Column:
    col = F.col(f"`{c}`")
    if isinstance(dt, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        s = F.replace(F.replace(col.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        for k, v in dump.ESCAPES.items():
            s = F.replace(s, F.lit(v), F.lit("\\" + k))
        lit = F.concat(F.lit("'"), s, F.lit("'"))
    else:
        lit = col.cast("string")
    return F.coalesce(lit, F.lit("NULL"))


def write_insert_tuples(df: DataFrame, path: str, table: str) -> None:
    """Sink: ``df`` as ``INSERT`` statements, one a row and line, built by column expressions alone. Line breaks and
    control characters in values are escaped, so a statement never spans lines."""
    values = F.concat_ws(",", *[_sql_literal(f.name, f.dataType) for f in df.schema.fields])
    df.select(F.concat(F.lit(f"INSERT INTO `{table}` VALUES ("), values, F.lit(");")).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """A report's sink. Reports are DataFrames; writing one is a parallel
    job (one file per task), never a collect. ``partition_by`` lays the output
    out by a column (e.g. ``campaign_id`` for a fact) so later filters prune.
    The report takes the place of an older one only when it is complete: a job
    that fails midway leaves the old one as it was."""
    by = [partition_by] if isinstance(partition_by, str) else partition_by
    layout.replace_folder(df, path, fmt, list(by) if by else None)
