import pytest
from models import RDF, grid_of, thing
from pyspark.sql import functions as F

from gridweft.storage import Stored, bucketed


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_joins_of_equal_buckets_need_no_shuffle(no_broadcast):
    rows = no_broadcast.range(500).select(F.lit("m").alias("model"), (F.col("id") % 50).cast("string").alias("id"), F.col("id").alias("v"))
    a = bucketed(rows, "a", "model", "id")
    b = bucketed(rows.groupBy("model", "id").agg(F.sum("v").alias("total")), "b", "model", "id", dealt=True)
    joined = a.join(b, ["model", "id"])
    assert shuffles(joined) == 0
    assert joined.groupBy("model", "id").agg(F.sum("v").alias("again"), F.first("total").alias("total")).where("again <> total").count() == 0
    assert joined.count() == 500


def test_lookups_leave_objects_where_they_are(no_broadcast):
    """Only the rows that refer are shuffled; ids that nothing has, null references and repeated ids are joined as before."""
    grid = grid_of(no_broadcast, RDF.format(thing("A", "1", refs={"r": "2"}) + thing("A", "3", refs={"r": "9"}) + thing("A", "4") + thing("B", "2") + thing("C", "2")))
    found = grid.deref(no_broadcast.createDataFrame([("m0", "_2"), ("m0", "_9"), ("m0", None), ("m1", "_2")], "model string, r string"), "r", "to")
    assert shuffles(found) == 1
    assert sorted(((x["model"], x["r"], x["to_type"]) for x in found.collect()), key=repr) == [("m0", "_2", "C"), ("m0", "_9", None), ("m0", None, None), ("m1", "_2", None)]


def test_buckets_of_null_and_empty_keys_and_no_rows(spark):
    rows = spark.createDataFrame([("m", None, 1), ("m", "", 2), (None, "x", 3), ("m", "", 2)], "model string, id string, v int")
    assert sorted(bucketed(rows, "nulls", "model", "id").collect(), key=repr) == sorted(rows.collect(), key=repr)
    assert bucketed(rows.where("v > 9"), "nothing", "model", "id").count() == 0


def test_dropped_tables_leave_the_catalog(spark):
    held = Stored(spark.range(5), "held", keys=["id"])
    assert spark.catalog.tableExists(held.table)
    held.drop()
    assert not spark.catalog.tableExists(held.table)
