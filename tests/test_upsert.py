import pytest
from conftest import rows
from pyspark.sql import functions as F

from ticketlens.operators import upsert
from ticketlens.operators.filters import timestamp
from ticketlens.session import scratch_path, shared_folder
from ticketlens.sources.warehouse import Warehouse

NOW, LATER = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def test_latest_wins_even_for_a_hot_key(spark):
    hot = spark.range(30000).select(F.lit(1).alias("id"), F.col("id").alias("seen"), (F.col("id") * 2).alias("v"))
    cold = spark.range(2, 50).select(F.col("id").cast("int").alias("id"), F.lit(5).cast("long").alias("seen"), F.col("id").alias("v"))
    out = upsert.latest_per_key(hot.unionByName(cold), ["id"], ["seen"])
    got = {r.id: r.v for r in out.collect()}
    assert len(got) == 49 and got[1] == 59998 and got[7] == 7


def test_absent_columns_keep_their_value_and_nulls_overwrite(spark):
    current = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, kept string")
    batch = spark.createDataFrame([(2, None), (3, "c")], "id int, name string")
    out = upsert.merge_snapshot(current, batch, ["id"])
    assert rows(out) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_empty_batch_changes_nothing(spark):
    current = spark.createDataFrame([(1, "a")], "id int, name string")
    out = upsert.merge_snapshot(current, current.limit(0), ["id"])
    assert rows(out) == [(1, "a")]


def test_merge_is_idempotent(spark):
    current = spark.createDataFrame([(i, i * 10) for i in range(20)], "id int, v int")
    batch = spark.createDataFrame([(i, i) for i in range(10, 30)], "id int, v int")
    once = upsert.merge_snapshot(current, batch, ["id"])
    assert rows(once) == rows(upsert.merge_snapshot(once, batch, ["id"]))


def test_replace_by_drops_vanished_rows(spark):
    current = spark.createDataFrame([("dbscan", 0), ("dbscan", 1), ("kmeans", 0)], "algorithm string, c int")
    batch = spark.createDataFrame([("dbscan", 0)], "algorithm string, c int")
    assert rows(upsert.replace_by(current, batch, "algorithm")) == [("dbscan", 0), ("kmeans", 0)]


def tickets(spark, ids, name):
    return spark.createDataFrame([(i, name) for i in ids], "id long, name string")


def test_warehouse_rewrites_only_touched_slices(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path), rows_per_slice=10)
    assert len(house.ensure_schema()) == 12 and house.ensure_schema() == []
    house.upsert("dim_tickets_enriched", tickets(spark, range(35), "old"), timestamp(NOW))
    house.upsert("dim_tickets_enriched", tickets(spark, [12, 99], "new"), timestamp(LATER))
    live = house._live("dim_tickets_enriched", None)
    assert live == {0: 2, 1: 3, 2: 2, 3: 2, 9: 3}
    got = {r.id: (r.name, str(r.loaded_at)) for r in house.read("dim_tickets_enriched").collect()}
    assert len(got) == 36
    assert got[12] == ("new", NOW) and got[99] == ("new", LATER) and got[0] == ("old", NOW)


def test_warehouse_replay_changes_nothing(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.upsert("dim_groups", spark.createDataFrame([(1, "a")], "id long, name string"), timestamp(NOW), version=1)
    batch = spark.createDataFrame([(1, "b"), (2, "c")], "id long, name string")
    first = None
    for _ in range(2):
        house.upsert("dim_groups", batch, timestamp(LATER), version=2)
        seen = rows(house.read("dim_groups"))
        first = first or seen
    assert seen == first and house.versions("dim_groups") == [1, 2]
    assert rows(house.read("dim_groups", below=2).select("id", "name")) == [(1, "a")]


def test_uncommitted_data_is_not_read(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.upsert("dim_groups", spark.createDataFrame([(1, "a")], "id long, name string"), timestamp(NOW))
    # a job killed after writing data, before its commit
    house._write("dim_groups", house.read("dim_groups").withColumn("name", F.lit("half")), 2)
    assert rows(house.read("dim_groups").select("name")) == [("a",)]


def test_nested_columns_survive(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    batch = spark.sql("SELECT 1L AS cluster_id, 'dbscan' AS algorithm, array('é') AS sample_titles, 3L AS ticket_count")
    house.upsert("ml_clusters", batch, timestamp(NOW))
    row = house.read("ml_clusters").first()
    assert row.sample_titles == ["é"] and str(row.computed_at) == NOW


def test_lineage_cuts_use_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named and scratch_path(spark, "x").startswith(named)
    assert spark.sparkContext.getCheckpointDir() is not None


def test_order_column_must_be_present(spark):
    df = spark.createDataFrame([(1, 2)], "id int, v int")
    with pytest.raises(ValueError):
        upsert.merge_snapshot(df, df, ["id"], order_by=["seen"])


def test_warehouse_keeps_rows_without_a_key(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path), rows_per_slice=10)
    house.ensure_schema()
    house.upsert("dim_tickets_enriched", tickets(spark, [1, None], "old"), timestamp(NOW))
    house.upsert("dim_tickets_enriched", tickets(spark, [None, 25], "new"), timestamp(LATER))
    got = {r.id: r.name for r in house.read("dim_tickets_enriched").collect()}
    assert got == {1: "old", None: "new", 25: "new"}
