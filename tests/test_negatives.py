"""Random negatives of users who have seen most of the catalogue."""

import datetime

import duckdb

from tidewright.plans.catalogue import ORACLES, QUERIES

PARTS = 2000
#: Unseen items of each user.
UNSEEN = {1: 1990, 2: 100, 3: 20, 4: 5, 5: 3, 6: 1, 7: 0}


def _tables(spark, folder):
    parts = list(range(1, PARTS + 1))
    lines, orders = [], []
    for user, n in UNSEEN.items():
        orders.append((user, user, datetime.date(2020, 1, 1)))
        lines += [(user, k, p, 1, 1.0) for k, p in enumerate(parts[: PARTS - n])]
    for name, rows, schema in (
        ("part", [(p, "n", "t", "b", 1.0, 1) for p in parts], "p_partkey long, p_name string, p_type string, p_brand string, p_retailprice double, p_size int"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate date"),
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_users_who_saw_most_items_get_all_their_negatives(spark, tmp_path):
    _tables(spark, tmp_path)
    got = {r.user_id: [int(x) for x in r.negatives.split(",")] for r in QUERIES["random_negatives"](spark, str(tmp_path)).collect()}
    assert set(got) == {u for u, n in UNSEEN.items() if n}
    for user, items in got.items():
        unseen = set(range(PARTS - UNSEEN[user] + 1, PARTS + 1))
        assert len(items) == len(set(items)) == min(5, len(unseen)) and set(items) <= unseen
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    # What the capped draws of the SQL find stands first, unchanged.
    for user, items in con.sql(ORACLES["random_negatives"]).fetchall():
        drawn = [int(x) for x in items.split(",")]
        assert got[user][: len(drawn)] == drawn
