"""The retail star as a plain value: one fact and three dimension DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RetailStar:
    fact_events: DataFrame
    dim_campaigns: DataFrame
    dim_products: DataFrame
    dim_stores: DataFrame
    # derived lazy plans (e.g. the KPI projection), built once per star
    memo: dict = field(default_factory=dict, compare=False, hash=False, repr=False)
    # the fact without its price, where a source has to look the price up
    unpriced: DataFrame | None = None
    # the collation that the texts were normalised by (``operators.collation``), and texts known to stand for their class
    collation: str | None = None
    canonical: tuple[str, ...] = ()

    @property
    def unit_events(self) -> DataFrame:
        """The fact for reports that read no price."""
        return self.unpriced if self.unpriced is not None else self.fact_events.drop("base_price")

    def text_is(self, column: str, text: str) -> Column:
        """A predicate on a text column that follows the star's collation."""
        if self.collation is None or text in self.canonical:
            return F.col(column) == F.lit(text)
        return F.collate(F.col(column), self.collation) == F.lit(text)

    def collated(self, collation: str = "UNICODE_CI_AI") -> "RetailStar":
        """The same star with every text column under a collation, as the source database compares text: the
        predicates, joins, groups and DISTINCTs of any report over it then follow the collation (F5), at the price of
        sort-based joins and aggregates. ``operators.collation.normalised`` gives the reports the same answers over
        plain text."""
        def under(df: DataFrame) -> DataFrame:
            return df.select(*[F.collate(F.col(f.name), collation).alias(f.name) if isinstance(f.dataType, T.StringType)
                               else F.col(f.name) for f in df.schema.fields])
        return RetailStar(under(self.fact_events), under(self.dim_campaigns), under(self.dim_products),
                          under(self.dim_stores), unpriced=under(self.unit_events))

    def persisted(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "RetailStar":
        """The same star with the fact kept by the executors after its first
        use (spilling to disk). For a session that runs many reports; a lost
        executor's blocks are recomputed from the lineage."""
        return RetailStar(self.fact_events.persist(level), self.dim_campaigns,
                          self.dim_products, self.dim_stores)

    def register(self, prefix: str = "") -> "RetailStar":
        """Expose the four tables as temp views (S3) for ``spark.sql`` users."""
        for name in ("fact_events", "dim_campaigns", "dim_products", "dim_stores"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        return self
