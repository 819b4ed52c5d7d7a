from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from unittest import mock

import pytest

from stockloom.operators import inventory as inv
from stockloom.sources import inventory_store
from stockloom.sources.inventory_store import InventoryStore
from stockloom.streaming.inventory_stream import apply_counts

UPDATES = "product_id string, new_quantity double, ts timestamp_ntz, n int"


def updates(spark, *rows):
    return spark.createDataFrame([(p, float(q), datetime(2024, 1, d), n) for p, q, d, n in rows], UPDATES)


def levels(df):
    return {r.product_id: r.current_stock for r in df.collect()}


@pytest.fixture(scope="module")
def catalog(spark):
    return inv.default_catalog(spark)


def test_defaults_of_the_catalog(catalog):
    got = levels(inv.defaults(catalog))
    assert got == {
        "P001": 3600, "P002": 2400, "P003": 1800, "P004": 2100, "P005": 3300, "P006": 1200,
        "P007": 2700, "P008": 1650, "P009": 1350, "P010": 2250, "P011": 900, "P012": 1950,
    }


def test_upsert_latest_wins_and_clamps(spark, catalog):
    counts = updates(spark, ("P001", 7.9, 2, 1), ("P001", 5, 1, 9), ("P002", 1, 3, 1), ("P002", 2, 3, 2), ("X", -5, 1, 1))
    got = inv.upsert(inv.defaults(catalog), counts)
    assert got.count() == 13
    found = levels(got)
    assert (found["P001"], found["P002"], found["X"], found["P003"]) == (7, 2, 0, 1800)
    assert levels(inv.upsert(got, counts)) == found
    stale = inv.upsert(got, updates(spark, ("P001", 99, 1, 1), ("P002", 50, 4, 1)))
    assert (levels(stale)["P001"], levels(stale)["P002"]) == (7, 50)


def test_back_fill_and_lookup(spark, catalog):
    known = inv.defaults(catalog).filter("product_id <> 'P004'")
    assert levels(inv.back_fill(known, catalog))["P004"] == 2100
    assert inv.stock_of(known, "P004").first().current_stock == 0
    assert inv.stock_of(known, "P011").first().current_stock == 900


def test_store(spark, catalog, tmp_path):
    store = InventoryStore(spark, str(tmp_path / "inv"), catalog)
    assert levels(store.stock_levels())["P001"] == 3600
    store.update_stock("P001", -3)
    store.update_stock("P099", 12)
    got = levels(store.stock_levels())
    assert (got["P001"], got["P099"], got["P002"]) == (0, 12, 2400)
    assert store.load().filter("product_id = 'P001'").first().last_updated is not None
    store.update_stock("P001", 44)
    assert levels(store.stock_levels())["P001"] == 44
    store.reset()
    assert levels(store.stock_levels()) == levels(inv.defaults(catalog))


def test_stream_equals_batch_and_ignores_late_counts(spark, catalog, tmp_path):
    source = str(tmp_path / "in")
    first = updates(spark, ("P001", 10, 5, 1), ("P002", 20, 5, 2))
    second = updates(spark, ("P001", 11, 4, 3), ("P002", 21, 6, 4), ("P003", 30, 1, 5))

    def open_store(session):
        return InventoryStore(session, str(tmp_path / "inv"), catalog)

    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(first.schema).parquet(source)
        apply_counts(stream, open_store, str(tmp_path / "cp")).awaitTermination()
    got = levels(open_store(spark).load())
    assert (got["P001"], got["P002"], got["P003"]) == (10, 21, 30)
    batch = inv.upsert(inv.defaults(catalog), first.unionByName(second))
    assert got == levels(batch)


def test_equal_times_give_the_same_in_one_batch_and_in_two(spark, catalog):
    one, two = updates(spark, ("P001", 50, 5, 1), ("P002", 7, 5, 1)), updates(spark, ("P001", 30, 5, 2), ("P002", 9, 5, 2))
    start = inv.defaults(catalog)
    at_once = levels(inv.upsert(start, one.unionByName(two)))
    assert (at_once["P001"], at_once["P002"]) == (50, 9)
    assert at_once == levels(inv.upsert(inv.upsert(start, one), two)) == levels(inv.upsert(inv.upsert(start, two), one))


def test_half_written_snapshot_is_not_served(spark, catalog, tmp_path):
    store = InventoryStore(spark, str(tmp_path / "inv"), catalog)
    store.update_stock("P001", 7)
    before = levels(store.stock_levels())
    inv.defaults(catalog).limit(3).write.parquet(str(tmp_path / "inv" / "snapshot=9"))
    (tmp_path / "inv" / "snapshot=9" / "_SUCCESS").unlink()
    assert levels(store.stock_levels()) == before and before["P001"] == 7
    store.update_stock("P002", 8)
    assert (levels(store.stock_levels())["P001"], levels(store.stock_levels())["P002"]) == (7, 8)


def test_old_snapshots_are_removed(spark, catalog, tmp_path):
    store = InventoryStore(spark, str(tmp_path / "inv"), catalog, retained=timedelta(0))
    for n in range(8):
        store.update_stock("P001", n)
    assert len(list((tmp_path / "inv").glob("snapshot=*"))) == 5
    assert levels(store.stock_levels())["P001"] == 7


def test_a_slow_reader_keeps_its_version(spark, catalog, tmp_path):
    store = InventoryStore(spark, str(tmp_path / "inv"), catalog)
    store.update_stock("P001", 1)
    loaded, version = store.load(), store.versions.newest()
    for n in range(8):
        store.update_stock("P001", 10 + n)
    assert levels(loaded)["P001"] == 1 == levels(store.load(version))["P001"]
    assert levels(store.load())["P001"] == 17


def test_two_writers_at_once_lose_no_count(spark, catalog, tmp_path):
    """The second writer publishes while the first computes; the first applies its counts again to what it finds."""
    one, two = (InventoryStore(spark, str(tmp_path / "inv"), catalog) for _ in range(2))
    one.load()
    upsert, calls = inv.upsert, []

    def interrupted(inventory, counts):
        if not calls:
            calls.append(1)
            two.update_stock("P002", 22)
        calls.append(2)
        return upsert(inventory, counts)

    with mock.patch.object(inv, "upsert", interrupted):
        one.update_stock("P001", 11)
    got = levels(one.stock_levels())
    assert (got["P001"], got["P002"]) == (11, 22) and calls.count(2) == 3  # one was tried twice
    assert one.versions.numbers() == [0, 1, 2] and not list((tmp_path / "inv").glob("_staged*"))


def test_many_writers_at_once(spark, catalog, tmp_path):
    InventoryStore(spark, str(tmp_path / "inv"), catalog).load()

    def write(k):
        InventoryStore(spark, str(tmp_path / "inv"), catalog).update_stock(f"P{k:03}", 1000 + k)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(1, 7)))
    got = levels(InventoryStore(spark, str(tmp_path / "inv"), catalog).stock_levels())
    assert [got[f"P{k:03}"] for k in range(1, 7)] == [1000 + k for k in range(1, 7)]


def test_a_failed_write_leaves_nothing(spark, catalog, tmp_path):
    store = InventoryStore(spark, str(tmp_path / "inv"), catalog)
    store.load()
    with pytest.raises(Exception, match="no_such_column"):
        store.save(inv.defaults(catalog).filter("no_such_column = 1"))
    assert store.versions.numbers() == [0] and not list((tmp_path / "inv").glob("_staged*"))


def test_changes_are_read_over_the_snapshot_and_folded_in(spark, catalog, tmp_path):
    store = InventoryStore(spark, str(tmp_path / "inv"), catalog)
    for n in range(inventory_store.CHANGES + 2):
        store.append(updates(spark, ("P001", 100 + n, 5, n % 50), ("NEW", n, 5, 0)))
    assert (levels(store.load())["P001"], levels(store.load())["NEW"]) == (100 + n, n)
    snapshot, behind = store._pending(store.versions.newest())
    assert snapshot == inventory_store.CHANGES + 1 and behind == [snapshot + 1]
    assert levels(store.load(3))["P001"] == 102


def test_a_batch_of_the_stream_writes_its_products_only(spark, catalog, tmp_path):
    source = str(tmp_path / "in")
    store = InventoryStore(spark, str(tmp_path / "inv"), catalog)
    for part in (updates(spark, ("P001", 10, 5, 1), ("P002", 20, 5, 2)), updates(spark, ("P002", 5, 4, 1), ("P003", 7, 6, 1))):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        apply_counts(stream, lambda session: store, str(tmp_path / "cp")).awaitTermination()
    changes = spark.read.parquet(f"{store.versions.folder(2)}/changes")
    # The late count of P002 doesn't change the state that the first run left.
    assert {r.product_id: r.current_stock for r in changes.collect()} == {"P002": 20, "P003": 7}
