"""Warehouse tables in the Spark catalog.

Parquet tables have no MERGE. A load reads the stored partitions its batch
touches, merges them as DataFrames, and writes the merged rows once, as a new version of just
those partitions in a folder of their own. Then a table of pointers gets a row for each of
them, and the catalog's partitions are set to the new folders. No file that a reader may
have in hand is overwritten or removed, and a partition goes from its old rows to its new ones in one
step. The pointers are the commit: without them a version is not there, and with them
``finish_swaps`` sets what a lost driver has left, also in a catalog that is new.

A table has one writer at a time. Old versions stay until their folders are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from epimill import schemas
from epimill.sinks.merge import insert_if_absent, replace_rows, upsert

POINTERS = "version bigint, value string, folder string"
VERSION = "epimill.version"
# Fixed value: the folder name that Spark gives a null.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


class Warehouse:
    """The five tables of one database.

    A new database goes to ``location``, or else to Spark's warehouse folder.
    """

    def __init__(self, spark: SparkSession, database: str = "epimill", location: str | None = None):
        self.spark = spark
        self.database = database
        if not location and not spark.catalog.databaseExists(database):
            local = spark.sparkContext.master.startswith("local")
            if not local and spark.conf.get("spark.sql.warehouse.dir").startswith("file:"):
                raise RuntimeError("name a location for the database that all executors share")
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")
        self.location = spark.catalog.getDatabase(database).locationUri.rstrip("/")

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def create_tables(self) -> None:
        """Create the tables that do not exist yet, with fixed schemas.

        Each table has its folder below the database, so that a catalog which does
        not outlive the application finds the stored rows again.
        """
        for table, schema in schemas.TABLES.items():
            self.create(table, schema, schemas.PARTITIONS.get(table))

    def create(self, table: str, schema: StructType, partition: str | None = None) -> None:
        fields = {field.name: field.dataType.simpleString() for field in schema}
        if partition:
            fields[partition] = fields.pop(partition, "string")
        columns = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
        by = f" PARTITIONED BY ({partition})" if partition else ""
        known = self.spark.catalog.tableExists(self.name(table))
        folder = f"{self.location}/{table}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet "
            f"OPTIONS ('partitionOverwriteMode' 'dynamic'){by} LOCATION '{folder}'"
        )
        if partition and not known:
            # Appending no rows makes sure there is a folder to look for partitions in.
            self.stored(table).where("false").write.mode("append").partitionBy(partition).parquet(folder)
            self.spark.sql(f"ALTER TABLE {self.name(table)} RECOVER PARTITIONS")
            self.finish_swaps(table)

    def read(self, table: str) -> DataFrame:
        """The table without columns that only storage knows."""
        return self.stored(table).select(*self._columns(table))

    def stored(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def _columns(self, table: str) -> list[str]:
        names = self.stored(table).columns
        hidden = schemas.STORAGE_COLUMNS.get(table, ("",))[0]
        return [name for name in names if name != hidden]

    def _with_storage(self, table: str, df: DataFrame) -> DataFrame:
        if table not in schemas.STORAGE_COLUMNS:
            return df
        name, rule = schemas.STORAGE_COLUMNS[table]
        return df.withColumn(name, F.expr(rule))

    @contextmanager
    def staged(self, df: DataFrame, label: str = "batch") -> Iterator[DataFrame]:
        """The rows written once as a table, for loads that read them several times."""
        table = self.name(f"stage_{label}_{uuid.uuid4().hex}")
        df.write.format("parquet").saveAsTable(table)
        try:
            yield self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def touched(self, df: DataFrame, partition: str) -> list:
        """Partition values of a batch: calendar days or type names, never row data."""
        return [row[0] for row in df.select(partition).distinct().collect()]

    def upsert(
        self, table: str, batch: DataFrame, source: DataFrame | None = None, whole_rows: bool = False
    ) -> None:
        """Update matching rows and insert the others, in the touched partitions.

        The partition column follows from the key, so a batch row can only match
        stored rows of its own partition. ``source`` are the stored rows that the
        batch is computed from; finding the partitions there keeps the batch itself
        from being computed twice. ``whole_rows`` updates all columns but the key.
        """
        self.finish_swaps(table)
        partition = schemas.PARTITIONS[table]
        batch = self._with_storage(table, batch)
        rows = batch if source is None else self._with_storage(table, source)
        stored = self.stored(table).where(in_values(partition, self.touched(rows, partition)))
        keys = schemas.KEYS[table]
        update = [c for c in stored.columns if c not in keys] if whole_rows else schemas.UPDATE_COLUMNS[table]
        self._commit(table, self._write_version(table, upsert(stored, batch, keys, update)))

    def insert_if_absent(self, table: str, batch: DataFrame) -> None:
        current = self.stored(table)
        batch = self._with_storage(table, batch)
        fresh = insert_if_absent(current, batch, schemas.KEYS[table])
        # Mostly few rows are new; the hint merges small tasks into few files.
        fresh.select(*current.columns).hint("rebalance").write.insertInto(self.name(table))

    def replace(
        self, table: str, batch: DataFrame, partition: str, first, last, doomed: Column
    ) -> None:
        """Delete rows that meet a condition within a partition range, then add a batch.

        A range without a first or last value is open on that side.
        Only partitions that hold such rows or get new ones are rewritten. Those left
        without rows are dropped: an overwrite would not see them.
        """
        self.finish_swaps(table)
        current = self.stored(table)
        batch = self._with_storage(table, batch)
        in_range = F.lit(True) if first is None else F.col(partition) >= F.lit(first)
        in_range = in_range if last is None else in_range & (F.col(partition) <= F.lit(last))
        before = self.touched(current.where(in_range & doomed), partition)
        stored = current.where(in_values(partition, [*before, *self.touched(batch, partition)]))
        folders = self._write_version(table, replace_rows(stored, batch, doomed & in_range))
        self._commit(table, {_text(value): None for value in before} | folders)

    def _versions(self, table: str) -> str:
        return f"{self.location}/_versions/{table}"

    def _write_version(self, table: str, rows: DataFrame) -> dict[str | None, str | None]:
        """Write the new rows of the touched partitions once; gives the folder of each partition value.

        One shuffle by partition value and key hash keeps the number of files low
        without sending a large day to a single task: AQE splits big partitions.
        """
        partition, folder = schemas.PARTITIONS[table], f"{self._versions(table)}/{uuid.uuid4().hex}"
        rows.select(*self.stored(table).columns).hint("rebalance", partition).write.partitionBy(partition).parquet(folder)
        folders = {unquote(path).rsplit("/", 1)[0] for path in self.spark.read.schema(self.stored(table).schema).parquet(folder).inputFiles()}
        values = {unquote(path.rsplit("=", 1)[1]): path for path in folders if "=" in path.rsplit("/", 1)[1]}
        return {None if value == NULL_PARTITION else value: path for value, path in values.items()}

    def _pointers(self, table: str) -> DataFrame | None:
        """(version, value, folder) of each partition that a load has set; no folder if it was dropped."""
        try:
            return self.spark.read.schema(POINTERS).parquet(f"{self._versions(table)}/pointers")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _commit(self, table: str, folders: dict[str | None, str | None]) -> None:
        """Add the pointers of one version, in one file, which makes it count; then set the catalog to it."""
        if folders:
            version = self._version(table) + 1
            rows = [pa.array([version] * len(folders), pa.int64()), pa.array(list(folders), pa.string()), pa.array(list(folders.values()), pa.string())]
            pointers = self.spark.createDataFrame(pa.table(rows, names=["version", "value", "folder"]))
            pointers.coalesce(1).write.mode("append").parquet(f"{self._versions(table)}/pointers")
            self._switch(table, version, folders)

    def _version(self, table: str) -> int:
        """The last version that the catalog has been set to."""
        told = {row["key"]: row["value"] for row in self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)}").collect()}
        return int(told.get(VERSION, 0))

    def finish_swaps(self, *tables: str) -> None:
        """Set the catalog's partitions to the folders of the versions it does not know yet.

        Where a driver was lost between a commit and its switch, the next load does it.
        """
        for table in tables or schemas.PARTITIONS:
            pointers = self._pointers(table)
            fresh = pointers and pointers.where(F.col("version") > self._version(table))
            if not fresh or fresh.isEmpty():
                continue
            last = F.max_by(F.struct("folder"), "version")["folder"].alias("folder")
            entries = fresh.groupBy("value").agg(last, F.max("version").alias("version")).collect()
            folders = {row["value"]: row["folder"] for row in entries}
            self._switch(table, max(row["version"] for row in entries), folders)

    def _switch(self, table: str, version: int, folders: dict[str | None, str | None]) -> None:
        """Set partitions to their folders; doing it twice changes nothing.

        They are set one by one: a reader may meet a new day beside an old one, but never
        half a day.
        """
        name, partition = self.name(table), schemas.PARTITIONS[table]
        known = {row[0] for row in self.spark.sql(f"SHOW PARTITIONS {name}").collect()}
        added = []
        for value, folder in folders.items():
            spot = f"PARTITION ({partition} = {_literal(value)})"
            if folder is None:
                self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {spot}")
            elif f"{partition}={NULL_PARTITION if value is None else value}" in known:
                self.spark.sql(f"ALTER TABLE {name} {spot} SET LOCATION {_literal(folder)}")
            else:
                added.append(f"{spot} LOCATION {_literal(folder)}")
        if added:
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(added)}")
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{VERSION}' = '{version}')")
        self.spark.catalog.refreshTable(name)


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def _literal(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_values(column: str, values: Sequence) -> Column:
    """Membership that also finds null when the list holds it."""
    known = [value for value in values if value is not None]
    found = F.col(column).isin(known)
    return found | F.col(column).isNull() if len(known) < len(values) else found
