"""The salt table."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.operators import salts
from footfall.sources.salt_store import SaltStore



def noon():
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def rows(spark, *entries):
    """Salt records from (key, salt, created) texts."""
    df = spark.createDataFrame(list(entries), "key string, given string, made string")
    made = df.select("key", "given", F.col("made").cast("timestamp").alias("made"))
    return salts.salt_rows(made, F.col("given"), F.col("made"))


def content(store):
    return {row["key"]: row["salt"] for row in store.load().collect()}


@pytest.fixture
def store(spark, folder):
    return SaltStore(spark, folder)


def test_missing_store_is_empty(store):
    assert store.load().count() == 0 and store.current_version() is None


def test_get_or_create_keeps_existing_salts(spark, store):
    store.insert(rows(spark, ("salt:2024-01-15:a", "mine", "2024-01-15 01:00:00")))
    wanted = keys(spark, "salt:2024-01-15:a", "salt:2024-01-15:b", "salt:2024-01-15:b")
    store.get_or_create(wanted, noon())
    first = content(store)
    assert first["salt:2024-01-15:a"] == "mine"
    assert len(first["salt:2024-01-15:b"]) == 64 and len(first) == 2
    store.get_or_create(wanted, noon())
    assert content(store) == first
    made = store.load().filter("site_uuid = 'b'").first()
    assert made["expires_at"] == datetime(2024, 1, 17)
    assert made["salt_date"].isoformat() == "2024-01-15"


def test_new_salts_differ_by_key_and_run(spark, folder):
    made = []
    for run in ("x", "y"):
        store = SaltStore(spark, f"{folder}/{run}")
        store.get_or_create(keys(spark, "salt:2024-01-15:a", "salt:2024-01-15:b"), noon())
        made += content(store).values()
    assert len(set(made)) == 4


def test_insert_refuses_taken_and_repeated_keys(spark, store):
    a = ("salt:2024-01-15:a", "1", "2024-01-15 00:00:00")
    b = ("salt:2024-01-15:b", "2", "2024-01-15 00:00:00")
    store.insert(rows(spark, a))
    with pytest.raises(salts.SaltExists):
        store.insert(rows(spark, b, a))
    with pytest.raises(salts.SaltExists):
        store.insert(rows(spark, b, b))
    assert content(store) == {a[0]: "1"}


def test_delete_and_clear(spark, store):
    store.insert(rows(spark, ("k1", "1", "2024-01-15 00:00:00"), ("k2", "2", "2024-01-16 00:00:00")))
    store.delete(keys(spark, "k1", "absent"))
    assert content(store) == {"k2": "2"}
    store.clear()
    assert content(store) == {} and store.current_version() == 3
    assert sorted(n for n in os.listdir(store.path) if n.startswith("v=")) == ["v=3"]


def test_cleanup_goes_by_creation_and_keeps_midnight(spark, store):
    store.insert(
        rows(
            spark,
            ("salt:2024-01-20:late", "1", "2024-01-14 23:59:59.999"),
            ("salt:2024-01-01:early", "2", "2024-01-15 00:00:00"),
            ("salt:2024-01-15:now", "3", "2024-01-15 11:00:00"),
        )
    )
    assert store.cleanup(noon()) == 1
    assert set(content(store).values()) == {"2", "3"}
    assert store.cleanup(noon()) == 0


def test_unfinished_version_does_not_count(spark, store):
    store.insert(rows(spark, ("k1", "1", "2024-01-15 00:00:00")))
    os.makedirs(f"{store.path}/v=2")
    assert content(store) == {"k1": "1"}


def test_corrupt_store_fails(spark, store):
    store.insert(rows(spark, ("k1", "1", "2024-01-15 00:00:00")))
    for root, _, files in os.walk(store.path):
        for name in files:
            if name.endswith(".parquet"):
                with open(f"{root}/{name}", "wb") as file:
                    file.write(b"broken")
                os.path.exists(f"{root}/.{name}.crc") and os.unlink(f"{root}/.{name}.crc")
    with pytest.raises(Exception):
        store.load().collect()


def test_lookup_shows_no_expiry(spark, store):
    store.insert(rows(spark, ("k1", "1", "2024-01-15 00:00:00")))
    found = salts.get_salts(keys(spark, "k1", "k2"), store.load())
    assert found.columns == ["key", "salt", "created_at"]
    assert {row["key"]: row["salt"] for row in found.collect()} == {"k1": "1", "k2": None}
    assert salts.all_salts(store.load()).columns == ["key", "salt", "created_at"]


def test_callers_that_race_agree(spark, folder):
    first, second = SaltStore(spark, folder), SaltStore(spark, folder)
    wanted = keys(spark, "salt:2024-05-01:a", "salt:2024-05-01:b")
    # Both find the keys missing before either has written.
    for store, secret in ((first, "x"), (second, "y")):
        made = salts.create_salts(
            wanted, spark.createDataFrame([(secret,)], "secret string"), F.timestamp_seconds(F.lit(1714521600))
        )
        store.append(made)
    rows = [sorted(map(tuple, store.get_or_create(wanted).select("key", "salt").collect())) for store in (first, second)]
    assert rows[0] == rows[1] and len(rows[0]) == 2


def test_only_wanted_days_are_read(spark, folder):
    store = SaltStore(spark, folder)
    store.get_or_create(keys(spark, "salt:2024-05-01:a", "salt:2024-05-02:a", "odd"))
    found = store.get_or_create(keys(spark, "salt:2024-05-02:a", "odd"))
    assert {r["key"] for r in found.collect()} == {"salt:2024-05-02:a", "odd"}
    assert "PartitionFilters: [" in found._jdf.queryExecution().toString()


def test_a_reader_keeps_the_version_it_has(spark, folder):
    store = SaltStore(spark, folder)
    before = store.get_or_create(keys(spark, "salt:2024-05-01:a"))
    store.cleanup(F.current_timestamp() + F.expr("INTERVAL 2 DAYS"), keep_previous=True)
    assert before.count() == 1 and store.load().count() == 0
    store.purge()
    assert len(store._all_versions()) == 1


def interleaved(store, other):
    """Let ``other`` run once after ``store`` has read the table and written, before it commits."""
    commit, ran = store._commit, []

    def late(entry):
        if not ran:
            ran.append(entry)
            other()
        return commit(entry)

    store._commit = late
    return ran


def test_two_callers_get_the_same_salt(spark, folder):
    first, second = SaltStore(spark, folder), SaltStore(spark, folder)
    wanted = keys(spark, "salt:2024-05-01:a", "salt:2024-05-01:b")
    got = {}
    # The second caller stores one of the keys first; the first one is the earlier by its clock.
    interleaved(first, lambda: got.update(second=second.get_or_create(keys(spark, "salt:2024-05-01:a"), noon()).collect()))
    got["first"] = first.get_or_create(wanted, F.lit("2024-01-01").cast("timestamp")).collect()
    salt = {name: {r["key"]: r["salt"] for r in rows} for name, rows in got.items()}
    assert salt["second"].items() <= salt["first"].items() and len(salt["first"]) == 2
    assert content(SaltStore(spark, folder)) == salt["first"]
    # A later caller with an earlier clock changes nothing.
    again = SaltStore(spark, folder).get_or_create(wanted, F.lit("2020-01-01").cast("timestamp"))
    assert {r["key"]: r["salt"] for r in again.collect()} == salt["first"]
    assert first.load().groupBy("key").count().filter("count > 1").count() == 0


def test_insert_beside_another_is_refused(spark, folder):
    first, second = SaltStore(spark, folder), SaltStore(spark, folder)
    mine, other = ("k1", "1", "2024-01-15 00:00:00"), ("k1", "2", "2024-01-14 00:00:00")
    interleaved(first, lambda: second.insert(rows(spark, other)))
    with pytest.raises(salts.SaltExists):
        first.insert(rows(spark, mine, ("k2", "3", "2024-01-15 00:00:00")))
    assert content(first) == {"k1": "2"}


def test_deletion_keeps_what_was_added_beside_it(spark, folder):
    first, second = SaltStore(spark, folder), SaltStore(spark, folder)
    first.insert(rows(spark, ("k1", "1", "2024-01-15 00:00:00"), ("k2", "2", "2024-01-15 00:00:00")))
    ran = interleaved(first, lambda: second.append(rows(spark, ("k3", "3", "2024-01-15 00:00:00"))))
    first.delete(keys(spark, "k1"))
    assert ran and content(second) == {"k2": "2", "k3": "3"}


def test_what_no_entry_names_does_not_count(spark, folder):
    store = SaltStore(spark, folder)
    store.insert(rows(spark, ("k1", "1", "2024-01-15 00:00:00")))
    rows(spark, ("k9", "9", "2024-01-15 00:00:00")).write.partitionBy("salt_date").parquet(f"{folder}/v=1/c=000000000002-x")
    assert content(store) == {"k1": "1"}
    assert not store._commit(store.current()) and not [n for n in os.listdir(f"{folder}/_log") if n.startswith(".") and not n.endswith(".crc")]
