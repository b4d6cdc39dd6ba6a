"""Stored tables: upserts, updates and checked appends, with replays."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from parley.sources import stored as T


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def files(path):
    return {b: sorted(glob.glob(f"{b}/*.parquet")) for b in glob.glob(f"{path}/bucket=*")}


def test_upsert_against_a_dict(spark, scratch):
    rnd = random.Random(2)
    table = T.KeyedTable(spark, f"{scratch}/t", "k", buckets=8)
    want, sets = {}, []
    for _ in range(4):
        sets.append([(rnd.randrange(40), rnd.randrange(100), rnd.choice("abc")) for _ in range(25)])
        sets.append(rnd.choice(sets))  # a replay, often older than what is stored
    for changes in sets:
        for k, v, x in changes:
            want[k] = max(want.get(k, (v, x)), (v, x))
        table.upsert(spark.createDataFrame(changes, "k long, v long, x string"), "v")
    assert rows(table.read(), "k", "v", "x") == sorted(((k, *r) for k, r in want.items()), key=str)


def test_upsert_rewrites_only_touched_buckets(spark, scratch):
    table = T.KeyedTable(spark, f"{scratch}/t", "k", buckets=8)
    table.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("v"), F.lit("a").alias("x")), "v")
    before = files(table.path)
    assert len(before) == 8
    change = spark.createDataFrame([(5, 2, "b")], "k long, v int, x string")
    assert table.upsert(change, "v") == 1
    after = files(table.path)
    assert sum(before[b] != after[b] for b in before) == 1
    assert rows(table.read().where("k = 5"), "v", "x") == [(2, "b")] and table.read().count() == 200
    plan = table.stored(table.touched(change))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert table.upsert(change.limit(0), "v") == 0


def test_update_greatest(spark, scratch):
    table = T.KeyedTable(spark, f"{scratch}/t", "id", buckets=4)
    table.create(spark.createDataFrame([(i, f"u{i}", None) for i in range(20)], "id long, name string, seen long"))
    deltas = [[(1, 5), (1, 9), (2, 3)], [(1, 4), (3, 1), (99, 7)], [(1, 5), (1, 9), (2, 3)]]
    for d in deltas:
        table.update_greatest(spark.createDataFrame(d, "id long, seen long"), "seen")
    assert rows(table.read().where("seen is not null"), "id", "seen") == [(1, 9), (2, 3), (3, 1)]
    assert table.read().count() == 20  # 99 is not stored: nothing to update


def append(spark, base, batches, parents, **more):
    rules = T.Constraints(
        checks=[("blank", F.length("name") > 0), *T.not_null(["owner"])],
        references=[("unknown_owner", "owner", parents, "id")],
        unique="name", unique_reason="taken", order=["at"], **more)
    for batch_id, b in batches:
        T.append_checked(spark.createDataFrame(b, "name string, owner long, at long"), batch_id, base, rules)
    read = lambda n: sorted(map(tuple, spark.read.parquet(f"{base}/{n}").collect()), key=str)
    return read("accepted"), read("rejected")


def test_checked_append(spark, scratch):
    parents = spark.createDataFrame([(1,), (1,), (2,)], "id long")  # a repeated parent does not multiply rows
    first = [("a", 1, 5), ("a", 2, 4), ("", 1, 1), (None, 1, 2), ("b", None, 1), ("c", 9, 1), ("d", 1, 1), ("d", 1, 1)]
    second = [("a", 1, 1), ("e", 2, 1), ("b", 1, 1), ("z", 1, 1)]
    taken = spark.createDataFrame([("z",)], "name string")
    good, bad = append(spark, f"{scratch}/x", [(0, first), (1, second)], parents, taken=taken)
    assert good == [("a", 2, 4, 0), ("b", 1, 1, 1), ("d", 1, 1, 0), ("e", 2, 1, 1)]
    assert bad == sorted([("a", 1, 5, "taken", 0), ("", 1, 1, "blank", 0), (None, 1, 2, "blank", 0), ("b", None, 1, "owner_is_null", 0),
                          ("c", 9, 1, "unknown_owner", 0), ("d", 1, 1, "taken", 0), ("a", 1, 1, "taken", 1), ("z", 1, 1, "taken", 1)], key=str)
    # replays of either batch change nothing; no row is lost or stored twice
    again = append(spark, f"{scratch}/x", [(0, first), (1, second), (1, second)], parents, taken=taken)
    assert again == (good, bad) and len(good) + len(bad) == len(first) + len(second)


def test_a_hot_key_is_not_gathered(spark, scratch):
    n = 30_000
    batch = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("name"), F.lit(1).cast("long").alias("owner"), F.col("id").alias("at"))
    rules = T.Constraints(unique="name", unique_reason="taken", order=["at"])
    T.append_checked(batch, 0, f"{scratch}/x", rules)
    good = spark.read.parquet(f"{scratch}/x/accepted")
    assert good.count() == n - n // 3 + 1 and good.where("name = 'hot'").first()["at"] == 0


@pytest.mark.parametrize("name", ["username", "password", "display_name"])
def test_registration_takes_missing_fields_as_blank(spark, name):
    from parley.operators.quality import registration
    row = {"request_id": 1, "copy": 0, "username": "ann", "password": "secret1", "display_name": "Ann", "email": None, name: None}
    schema = "request_id long, copy int, username string, password string, display_name string, email string"
    req = spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)
    got = registration(req, spark.createDataFrame([], "username string")).first()
    assert got["status"] == "missing_fields" and got["password_hash"] is None
