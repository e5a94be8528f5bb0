"""Loads: the relational tables written under a folder, replaced in one step.

A load writes all its tables into a folder of its own, with surrogate keys and
the load's time, and is committed by appending one row to the table ``loads`` (one
file, which appears whole or not at all).  ``current`` reads the last committed row
once and gives the tables of that load: readers see the former tables or
the new ones, never a mix, and a load that dies on the way leaves the former
ones as they were.  The row also holds the highest keys given so far.

Keys behave like a serial column: subscriptions and usage rows of a customer
that the former load holds keep their numbers, new ones continue without gaps
after the highest number ever given, in order of customer id.  A repeated load
therefore gives the same keys; numbers of rows that went are not given again.

Layout below the root::

    loads/                      one JSON row for each committed load
    load-000002-<token>/        records (bucketed by customer), subscription_plans, rejects

Where customer ids are unique the records are bucketed and sorted by them, so
joins between the tables need no exchange.  The relational tables are views
over the records; a load's catalog database is defined anew from its folder
where the session does not know it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.operators import audit
from churnlens.plans.numbering import gapless
from churnlens.plans.tables import ChurnTables
from churnlens.schemas import CUSTOMER_COLUMNS, USAGE_COLUMNS, WIDE_COLUMNS
from churnlens.session import hadoop_path
from churnlens.sources.warehouse import with_defaults

BUCKETS_CONF = "spark.churnlens.buckets"
# a bucket file holds about BUCKET_BYTES of records of about ROW_BYTES (compressed)
BUCKET_BYTES = 256 << 20
ROW_BYTES = 100

LOADS_SCHEMA = T.StructType([
    T.StructField("load_id", T.LongType()),
    T.StructField("token", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("loaded_at", T.TimestampType()),
    T.StructField("buckets", T.IntegerType()),
    T.StructField("customers", T.LongType()),
    T.StructField("subscriptions", T.LongType()),
    T.StructField("rejected", T.LongType()),
    T.StructField("subscription_high", T.LongType()),
    T.StructField("metric_high", T.LongType()),
])

_VIEWS = {
    "customers": f"SELECT {', '.join(CUSTOMER_COLUMNS)}, loaded_at AS created_at FROM {{db}}.records",
    "subscriptions": "SELECT subscription_id, customer_id, plan_id, plan_name, plan_price, join_date AS start_date, "
                     "cancellation_date AS end_date, NOT is_churned AS is_active FROM {db}.records WHERE plan_id IS NOT NULL",
    "usage_metrics": f"SELECT metric_id, {', '.join(USAGE_COLUMNS)}, loaded_at AS recorded_at FROM {{db}}.records",
}


def bucket_count(spark: SparkSession, rows: int, buckets: int | None = None) -> int:
    """Explicit argument, else ``spark.churnlens.buckets``, else by the records' size."""
    configured = buckets or spark.conf.get(BUCKETS_CONF, None)
    return max(1, int(configured)) if configured else 1 + rows * ROW_BYTES // BUCKET_BYTES


class _Stage:
    """Intermediate tables of one load, deleted when it is written."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self._path}/{name}")
        return self._spark.read.schema(df.schema).parquet(f"{self._path}/{name}")

    def drop(self) -> None:
        fs, path = hadoop_path(self._spark, self._path)
        fs.delete(path, True)


class Warehouse:
    """The loads below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self._root}/{name}"

    def history(self) -> DataFrame:
        """One row for each committed load."""
        fs, path = hadoop_path(self._spark, self._path("loads"))
        if not fs.exists(path):
            return self._spark.createDataFrame([], LOADS_SCHEMA)
        return self._spark.read.schema(LOADS_SCHEMA).json(self._path("loads"))

    def _last(self) -> Row | None:
        return self.history().orderBy(F.desc("load_id"), F.desc("token")).first()

    def current_folder(self) -> str | None:
        last = self._last()
        return self._path(last.folder) if last else None

    def current(self) -> ChurnTables | None:
        """The tables of the last committed load; None where there is none."""
        last = self._last()
        return self._open(last) if last else None

    # -- writing ----------------------------------------------------------------

    def load(self, tables: ChurnTables, unique_key: bool = True, buckets: int | None = None,
             export: bool = False, reject: bool = False, written: bool = False) -> ChurnTables:
        """Write ``tables`` as the next load and make it the current one.

        ``reject``: records that break a declared constraint are not loaded but written
        to the load's table of rejects, with the names of what they break.

        ``unique_key``: customer ids are unique and present; else the load fails
        before any record is written.  Without it (records whose ids may repeat,
        one of which could hold a third of all rows) rows are numbered one by
        one, nothing is bucketed and no key is kept.  ``export`` also writes
        the relational tables as Parquet folders (``tables/`` beside the records).
        ``written``: the records lie in a table that does not change; others are written
        first, so that keys and records read the same rows and these are derived once.
        """
        former = self._last()
        load_id = former.load_id + 1 if former else 1
        token = uuid.uuid4().hex[:12]
        folder = f"load-{load_id:06d}-{token}"
        database = self._create_database(folder, token)
        try:
            row = self._write(tables, former, Row(load_id=load_id, token=token, folder=folder), unique_key, buckets,
                              reject, written)
            loaded = self._open(row)
            if export:
                for name in (*_VIEWS, "subscription_plans"):
                    self._spark.table(f"{database}.{name}").write.parquet(f"{self._path(folder)}/tables/{name}")
            self._commit(row)
        except BaseException:
            self._remove(folder)
            raise
        return loaded

    def _write(self, tables: ChurnTables, former: Row | None, load: Row, unique_key: bool, buckets: int | None,
               reject: bool, written: bool) -> Row:
        database, stage = f"churnlens_{load.token}", self._stage(load.folder)
        now = datetime.now(timezone.utc).replace(microsecond=0)
        stamp = F.to_timestamp(F.lit(now.isoformat()))
        high = {k: former[f"{k}_high"] if former else 0 for k in ("subscription", "metric")}

        plans = tables.subscription_plans
        self._write_plans(plans.withColumn("created_at", stamp), database, load.folder)
        wide = with_defaults(with_defaults(tables.wide, "customers"), "usage_metrics").select(*WIDE_COLUMNS)
        lookup = plans.select("plan_id", F.col("plan_name").alias("_lookup_name"))
        by_name = F.col("plan_name") == F.col("_lookup_name")
        rejected = 0
        if reject:
            wide, rejected = self._split(wide.join(lookup, by_name, "left").drop("_lookup_name"), load.folder, stage)
        elif not written:
            wide = stage(wide, "wide")
        if unique_key:
            ids = wide.select("customer_id", "plan_name").join(lookup, by_name, "left").select("customer_id", "plan_id")
            keys = self._keyed(ids, former, high, stage)
            n_buckets = bucket_count(self._spark, self._require_unique(keys), buckets)
            records = wide.join(keys, "customer_id")
        else:
            n_buckets = 0
            numbers = {"subscription_id": (F.col("plan_id").isNotNull(), high["subscription"]),
                       "metric_id": (F.lit(True), high["metric"])}
            order = ["customer_id", *[c for c in WIDE_COLUMNS if c != "customer_id"]]
            records = gapless(wide.join(lookup, by_name, "left").drop("_lookup_name"),
                              [F.col(c).asc_nulls_last() for c in order], numbers, stage)
        records = records.select(*WIDE_COLUMNS, "plan_id", "subscription_id", "metric_id", stamp.alias("loaded_at"))
        self._write_records(records, database, load.folder, n_buckets)
        stage.drop()
        written = self._spark.table(f"{database}.records").agg(
            F.count(F.lit(1)).alias("customers"), F.count("plan_id").alias("subscriptions"),
            F.max("subscription_id").alias("subscription"), F.max("metric_id").alias("metric")).first()
        return Row(**load.asDict(), loaded_at=now, buckets=n_buckets, customers=written.customers,
                   subscriptions=written.subscriptions, rejected=rejected,
                   **{f"{k}_high": max(high[k], written[k] or 0) for k in ("subscription", "metric")})

    def _split(self, named: DataFrame, folder: str, stage: Callable) -> tuple[DataFrame, int]:
        """The records that break nothing, and the number of the others, which are written as rejects."""
        rows = named.select("*", *audit.row_structs(named))
        audited = stage(audit.with_repeated_ids(audit.with_broken_rows(rows)).select(*WIDE_COLUMNS, "broken"), "audited")
        path = f"{self._path(folder)}/rejects"
        audit.rejects(audited).write.parquet(path)
        return audit.accepted(audited), self._spark.read.parquet(path).count()

    def rejects(self) -> DataFrame | None:
        """What the last committed load rejected; None where it took everything."""
        last = self._last()
        return self._spark.read.parquet(f"{self._path(last.folder)}/rejects") if last and last.rejected else None

    def _keyed(self, ids: DataFrame, former: Row | None, high: dict[str, int], stage: Callable) -> DataFrame:
        """(customer_id, plan_id, subscription_id, metric_id): known keys kept, new ones numbered."""
        if former:
            known = self._open(former).records.select("customer_id", "subscription_id", "metric_id")
            ids = ids.join(known, "customer_id", "left")
        else:
            none = F.lit(None).cast("bigint")
            ids = ids.withColumns({"subscription_id": none, "metric_id": none})
        # a customer without a known plan holds no subscription, so no number either
        kept = F.when(F.col("plan_id").isNotNull(), F.col("subscription_id"))
        numbers = {"new_subscription": (F.col("plan_id").isNotNull() & kept.isNull(), high["subscription"]),
                   "new_metric": (F.col("metric_id").isNull(), high["metric"])}
        numbered = gapless(ids, [F.col("customer_id")], numbers, stage)
        return stage(numbered.select("customer_id", "plan_id", F.coalesce(kept, "new_subscription").alias("subscription_id"),
                                     F.coalesce("metric_id", "new_metric").alias("metric_id")), "keys")

    @staticmethod
    def _require_unique(keys: DataFrame) -> int:
        """The number of rows; fails on absent or repeated ids."""
        groups = keys.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
        found = groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.count(F.when(F.col("customer_id").isNotNull() & (F.col("n") > 1), True)).alias("repeated"),
            F.coalesce(F.sum(F.when(F.col("customer_id").isNull(), F.col("n"))), F.lit(0)).alias("absent")).first()
        if found.repeated or found.absent:
            raise ValueError(f"customer_id is a primary key: {found.repeated} ids are repeated, {found.absent} rows have "
                             "none (`clean --dedup key` keeps one row of an id)")
        return found.n

    def _stage(self, folder: str) -> _Stage:
        return _Stage(self._spark, f"{self._path(folder)}/stage")

    def _write_plans(self, plans: DataFrame, database: str, folder: str) -> None:
        self._writer(plans, folder, "subscription_plans").saveAsTable(f"{database}.subscription_plans")

    def _write_records(self, records: DataFrame, database: str, folder: str, buckets: int) -> None:
        if buckets:
            self._writer(records.repartition(buckets, "customer_id"), folder, "records") \
                .bucketBy(buckets, "customer_id").sortBy("customer_id").saveAsTable(f"{database}.records")
        else:
            self._writer(records, folder, "records").saveAsTable(f"{database}.records")

    def _writer(self, df: DataFrame, folder: str, name: str) -> DataFrameWriter:
        return df.write.format("parquet").option("path", f"{self._path(folder)}/{name}")

    def _commit(self, row: Row) -> None:
        self._spark.createDataFrame([tuple(row[f] for f in LOADS_SCHEMA.names)], LOADS_SCHEMA).coalesce(1).write.mode("append").json(self._path("loads"))

    # -- reading ----------------------------------------------------------------

    def _create_database(self, folder: str, token: str) -> str:
        database = f"churnlens_{token}"
        # tables lie outside the database's own folder, which Spark deletes with the database
        self._spark.sql(f"CREATE DATABASE {database} LOCATION '{self._path(folder)}/catalog'")
        return database

    def _open(self, load: Row) -> ChurnTables:
        spark, database = self._spark, f"churnlens_{load.token}"
        if not spark.catalog.databaseExists(database):
            self._create_database(load.folder, load.token)
        known = {t.name for t in spark.catalog.listTables(database)}
        for name, buckets in (("records", load.buckets), ("subscription_plans", 0)):
            if name not in known:
                path = f"{self._path(load.folder)}/{name}"
                ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
                clustered = f"CLUSTERED BY (customer_id) SORTED BY (customer_id) INTO {buckets} BUCKETS" if buckets else ""
                spark.sql(f"CREATE TABLE {database}.{name} ({ddl}) USING parquet {clustered} LOCATION '{path}'")
        for name, text in _VIEWS.items():
            if name not in known:
                spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {text.format(db=database)}")
        records = spark.table(f"{database}.records")
        return ChurnTables(
            wide=records.select(*WIDE_COLUMNS),
            customers=spark.table(f"{database}.customers"),
            subscriptions=spark.table(f"{database}.subscriptions"),
            subscription_plans=spark.table(f"{database}.subscription_plans"),
            usage_metrics=spark.table(f"{database}.usage_metrics"),
            database=database,
            records=records,
            folder=self._path(load.folder),
            buckets=load.buckets,
        )

    def release(self, tables: ChurnTables) -> None:
        """Forget the catalog's entries of a load; its files stay."""
        self._spark.sql(f"DROP DATABASE IF EXISTS {tables.database} CASCADE")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders of unfinished loads and of all but the last ``keep`` committed ones; gives their names.

        Not to be called while another load is being written.
        """
        committed = [r.folder for r in self.history().orderBy(F.desc("load_id"), F.desc("token")).select("folder").collect()]
        fs, root = hadoop_path(self._spark, self._root)
        if not fs.exists(root):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(root)]
        gone = sorted(n for n in found if n.startswith("load-") and n not in committed[:keep])
        for name in gone:
            self._remove(name)
        return gone

    def _remove(self, folder: str) -> None:
        self._spark.sql(f"DROP DATABASE IF EXISTS churnlens_{folder.rpartition('-')[2]} CASCADE")
        fs, path = hadoop_path(self._spark, self._path(folder))
        fs.delete(path, True)

    def drop(self) -> None:
        """Delete all loads."""
        self.vacuum(keep=0)
        fs, root = hadoop_path(self._spark, self._root)
        fs.delete(root, True)
