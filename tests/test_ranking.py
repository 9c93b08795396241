from pyspark.sql import functions as F

from waymesh.operators.ranking import chain_places


def test_chains_rings_and_single_items(spark):
    chain = [(k * 7 % 101, (k + 1) * 7 % 101) for k in range(60)]
    ring = [(200, 205), (205, 203), (203, 200)]
    links = spark.createDataFrame(chain + ring + [(300, 299)], "u long, v long")
    items = spark.createDataFrame([(i,) for i in range(101)] + [(200,), (203,), (205,), (299,), (300,), (400,)], "id long")
    got = {r.id: (r.chain, r.place) for r in chain_places(links, items).collect()}
    assert len(got) == 101 + 6
    assert [got[k * 7 % 101] for k in range(61)] == [(0, k) for k in range(61)]
    assert got[200] == (200, 0) and got[205] == (200, 1) and got[203] == (200, 2)
    assert got[300] == (300, 0) and got[299] == (300, 1) and got[400] == (400, 0)


def test_ids_may_be_structs_and_tables_empty(spark):
    items = spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, gram string").select(F.struct("lang", "gram").alias("id"))
    links = spark.createDataFrame([(("en", "b"), ("en", "a"))], "u struct<lang:string,gram:string>, v struct<lang:string,gram:string>")
    assert {r.id.gram: r.place for r in chain_places(links, items).collect()} == {"b": 0, "a": 1}
    assert chain_places(links.limit(0), items.limit(0)).count() == 0
