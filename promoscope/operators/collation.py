"""a database's case- and accent-insensitive comparison by normalised texts.

Spark compares collated text by its collation in every join, group and DISTINCT, which rules out hash aggregates and costs a
collation key a row. Here the collation works once per distinct text instead: texts that it holds equal form a class,
one of them stands for the class, and every other text of the class is replaced by it. After that, plain binary
comparison gives the collation's answers, with hash joins and hash aggregates.

The distinct texts of all key and attribute columns are found in one pass over each table (partially aggregated), and
only texts that are to be replaced (``bogof`` where ``BOGOF`` stands for the class) are kept: the exceptions, by
domain. A column without exceptions is left as it is; the others meet their exceptions by a left join, broadcast if
they measure small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.functions.kpi import PROMO_RULES
from promoscope.operators.star import sized_broadcast
from promoscope.session import materialize
from promoscope.sources.star import RetailStar

#: Texts that stand for their class wherever they occur in it: the promo labels that the pricing rules compare with.
LABELS = tuple(rule[0] for rule in PROMO_RULES)
#: The fact's key is compared by no report: nothing to normalise, and as many texts as rows.
NOT_NORMALISED = ("event_id",)


def _domains(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in NOT_NORMALISED]


def _texts(df: DataFrame) -> DataFrame:
    """(domain, value): the distinct texts of every column. A key is one domain in fact and dimension."""
    cols = _domains(df)
    which = F.lit(None).cast("string")
    for c in cols:
        which = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(which)
    sets = df.groupingSets([[c] for c in cols], *cols).agg(which.alias("domain"))
    return sets.select("domain", F.coalesce(*cols).alias("value")).filter(F.col("value").isNotNull())


def exceptions(tables: list[DataFrame], collation: str, labels: tuple[str, ...] = LABELS, label_domain: str = "promo_type") -> DataFrame:
    """(domain, value, instead): the texts that another text of their class stands for: a label, or the least of the
    class in binary order."""
    spark = tables[0].sparkSession
    known = spark.createDataFrame([(label_domain, label) for label in labels], "domain string, value string")
    texts = materialize(reduce(DataFrame.union, [_texts(df) for df in tables], known).distinct(), "texts")
    under = texts.withColumn("class", F.collate("value", collation))
    label = F.when((F.col("domain") == label_domain) & F.col("value").isin(*labels), F.col("value"))
    classes = (under.groupBy("domain", "class").agg(F.coalesce(F.min(label), F.min("value")).alias("instead"), F.count("*").alias("texts"))
               .filter("texts > 1").select("domain", "class", "instead"))
    return under.join(classes, ["domain", "class"]).filter("value <> instead").select("domain", "value", "instead")


def normalised(star: RetailStar, collation: str = "UNICODE_CI_AI") -> RetailStar:
    """``star`` with every text replaced by the one that stands for its class under ``collation``. Runs the pass over
    the tables' distinct texts; keep the star to pay for it once."""
    tables = [star.unit_events, star.dim_campaigns, star.dim_products, star.dim_stores]
    known = materialize(exceptions(tables, collation), "exceptions")
    some = {r.domain for r in known.select("domain").distinct().collect()}        # columns, not texts
    maps = {d: sized_broadcast(known.filter(F.col("domain") == d).select(F.col("value").alias(f"_{d}_is"), F.col("instead").alias(f"_{d}_to")))
            for d in some}

    def over(df: DataFrame) -> DataFrame:
        out = df
        for d in _domains(df):
            if d in maps:
                out = out.join(maps[d], F.col(d) == F.col(f"_{d}_is"), "left").withColumn(d, F.coalesce(f"_{d}_to", d))
        return out.select(*df.columns)

    return RetailStar(over(star.fact_events), over(star.dim_campaigns), over(star.dim_products), over(star.dim_stores),
                      unpriced=over(star.unit_events), collation=collation, canonical=LABELS)
