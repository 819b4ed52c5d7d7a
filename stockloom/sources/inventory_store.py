"""Inventory on storage: numbered versions, each a whole snapshot or the changes since the one before.

A bulk change writes the whole next snapshot (one row per product); a stream's batch writes its changed rows only. The current inventory is
the newest snapshot with the changes behind it. Versions are published whole (see ``versions``), so that writers may work
side by side and readers never see half of one; a loaded inventory stays that of its moment, whatever is written meanwhile.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.operators import inventory as ops
from stockloom.sources import files
from stockloom.sources.versions import RETAINED, Versions

#: Versions that stay however old they are, and versions with changes after which a snapshot is due.
KEPT, CHANGES = 5, 20


class InventoryStore:
    def __init__(self, spark: SparkSession, path: str, catalog: DataFrame, retained: timedelta = RETAINED):
        self.spark, self.path, self.catalog = spark, path, catalog
        self.versions = Versions(spark, path, "snapshot", retained)

    def _changes(self, version: int) -> str:
        return f"{self.versions.folder(version)}/changes"

    def _pending(self, version: int) -> tuple[int, list[int]]:
        """The newest snapshot up to a version, and the versions with changes behind it."""
        behind = []
        for number in reversed([n for n in self.versions.numbers() if n <= version]):
            if not files.exists(self.spark, self._changes(number)):
                return number, behind[::-1]
            behind.append(number)
        raise FileNotFoundError(f"{self.path}: no snapshot up to version {version}")

    def _read(self, version: int) -> DataFrame:
        snapshot, behind = self._pending(version)
        stored = self.spark.read.schema(ops.INVENTORY_SCHEMA)
        inventory = stored.parquet(self.versions.folder(snapshot))
        if not behind:
            return inventory
        changes = stored.parquet(*[self._changes(n) for n in behind])
        return ops.upsert(inventory, changes.select("product_id", F.col("current_stock").alias("new_quantity"), F.col("last_updated").alias("ts")))

    def load(self, version: int | None = None) -> DataFrame:
        """The inventory of a version, by default the newest; the first call stores the defaults. New catalog products are added."""
        version = self.versions.newest() if version is None else version
        if version is None:
            self.reset()
            version = self.versions.newest()
        return ops.back_fill(self._read(version), self.catalog)

    def _publish(self, next_of) -> int:
        def fill(folder: str, newest: int | None) -> None:
            next_of(newest).select("product_id", "current_stock", "last_updated").write.parquet(folder)

        number = self.versions.publish(fill)
        snapshot, _ = self._pending(number)
        self.versions.remove_old(max(KEPT, number - snapshot + 1))
        return number

    def save(self, inventory: DataFrame) -> int:
        """Publish an inventory as the newest, whatever there was; its version."""
        return self._publish(lambda newest: inventory)

    def bulk_update(self, updates: DataFrame) -> int:
        """Apply counts (product_id, new_quantity and optionally ts, by default the time of the call); the version they make.

        If another writer is faster, the counts are applied again to what it wrote.
        """
        if "ts" not in updates.columns:
            updates = updates.withColumn("ts", F.current_timestamp().cast("timestamp_ntz"))
        if self.versions.newest() is None:
            self.reset()
        return self._publish(lambda newest: ops.upsert(self.load(newest), updates))

    def append(self, counts: DataFrame) -> int:
        """Apply counts by writing only the products that they are of. Their effect doesn't depend on what is stored,
        so that nothing is read or tried again; now and then a snapshot is written instead."""
        if self.versions.newest() is None:
            self.reset()
        if len(self._pending(self.versions.newest())[1]) >= CHANGES:
            return self.bulk_update(counts)
        changes = ops.latest_counts(counts).select(
            "product_id", F.col("_quantity").alias("current_stock"), F.col("_ts").alias("last_updated"))
        return self.versions.add(lambda folder: changes.write.parquet(f"{folder}/changes"))

    def update_stock(self, product_id: str, new_quantity: float, ts: datetime | None = None) -> None:
        row, schema = (product_id, float(new_quantity)), "product_id string, new_quantity double"
        if ts is not None:
            row, schema = (*row, ts), f"{schema}, ts timestamp_ntz"
        self.bulk_update(self.spark.createDataFrame([row], schema))

    def stock_levels(self) -> DataFrame:
        return self.load().select("product_id", "current_stock")

    def reset(self) -> None:
        self.save(ops.defaults(self.catalog))
