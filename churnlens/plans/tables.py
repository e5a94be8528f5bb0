"""The table bundle every analytics operator takes, lazily derived or materialised.

``ChurnTables.derive`` builds a lazy plan over the driver's tables.  The
reference loads its data once and then runs many queries; ``materialize`` does
the same: it writes the wide record with its surrogate keys once, bucketed and
sorted by ``customer_id``, below the shared checkpoint folder (``plans.loads``), and
defines the relational tables (customers, subscriptions, usage_metrics) as
catalog views over it.  They are column projections of one columnar table,
so a query reads only its columns, joins between them are sort-merge joins on
the shared bucketing without an exchange, and the load writes the data once.
Lineage is cut: a lost executor recomputes from the written files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from churnlens.session import hadoop_path, scratch_path
from churnlens.sources.tpch import derive_wide
from churnlens.sources.warehouse import (
    load_customers,
    load_subscriptions,
    load_usage_metrics,
    plans_frame,
)


@dataclass(frozen=True)
class ChurnTables:
    wide: DataFrame
    customers: DataFrame
    subscriptions: DataFrame
    subscription_plans: DataFrame
    usage_metrics: DataFrame
    database: str | None = None
    records: DataFrame | None = None  # a load's wide rows with their plan, surrogate keys and load time
    folder: str | None = None
    buckets: int = 0

    @staticmethod
    def from_wide(wide: DataFrame) -> "ChurnTables":
        spark = wide.sparkSession
        plans = plans_frame(spark)
        return ChurnTables(
            wide=wide,
            customers=load_customers(wide),
            subscriptions=load_subscriptions(wide, plans),
            subscription_plans=plans,
            usage_metrics=load_usage_metrics(wide),
        )

    @staticmethod
    def derive(spark: SparkSession, sf_dir: str) -> "ChurnTables":
        return ChurnTables.from_wide(derive_wide(spark, sf_dir))

    def materialize(self, buckets: int | None = None, bucketed: bool = True) -> "ChurnTables":
        """The bundle loaded into a warehouse of its own; ``bucketed``: customer ids are unique."""
        from churnlens.plans.loads import Warehouse

        spark = self.wide.sparkSession
        return Warehouse(spark, scratch_path(spark, "warehouse")).load(self, unique_key=bucketed, buckets=buckets)

    def drop(self) -> None:
        """Drop the written tables, files included; a lazy bundle has none."""
        if self.database:
            spark = self.wide.sparkSession
            spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
            fs, path = hadoop_path(spark, self.folder)
            fs.delete(path, True)
