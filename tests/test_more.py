import pytest
from pyspark.sql import functions as F

from waymark import plans
from waymark.operators import sampling
from waymark.streaming import feed
from waymark.sources import dump

LINE = '{"type":"Place","content":[{"address_type":"street","name":{"name":"%s"},"address":{"city":"T"},"centroid":[1,2]}]}'


def test_stream_of_dumps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, n in enumerate(("Alte Gasse", "Neuer Weg")):
        (tmp_path / "in" / f"{i}.jsonl").write_text(LINE % n + "\n")
    where = [str(tmp_path / x) for x in ("in", "table", "check")]
    feed.append_places(spark, *where, ["de"]).awaitTermination()
    assert {r.name for r in spark.read.parquet(where[1]).collect()} == {"Alte Gasse", "Neuer Weg"}
    (tmp_path / "in" / "2.jsonl").write_text(LINE % "Dritter Ring" + "\n")
    feed.append_places(spark, *where, ["de"]).awaitTermination()
    table = spark.read.parquet(where[1])
    assert table.count() == 3
    known = spark.createDataFrame([("alte",), ("gasse",), ("t",)], "word string")
    assert {"neuer", "weg", "dritter", "ring"} <= {r.word for r in feed.new_words(table, known).collect()} and feed.new_words(table, known).where("word = 'alte'").isEmpty()
    feed.running_census(spark, where[0], ["de"], "census", str(tmp_path / "c2")).awaitTermination()
    assert spark.table("census").where(f"kind = {dump.STREET}").first().places == 3


def test_sampling(spark):
    df = spark.range(1000)
    assert sampling.sample(df, "id", 7).collect() == sampling.sample(df.repartition(5), "id", 7).collect()
    assert 60 < sampling.thinned(df, 0.1, "id").count() < 140
    rows = spark.createDataFrame([(1, "Alte Hauptstraße", "12a", "53111", "Bonn (Rhein)", 50.7, 7.1)], "id long, street string, number string, postcode string, city string, lat double, lon double")
    got = {r.category: r for r in sampling.address_queries(rows).collect()}
    assert got["address.abbreviated"].query == "Alte Hauptstr. 12a Bonn (Rhein)" and got["street.typing"].query == "Alte Hauptst" and got["town"].query == "Bonn" and got["address.plain"].query == "Alte Hauptstrasse 12a Bonn (Rhein)"
    assert len(got["address.swapped"].query) == len("Alte Hauptstraße 12a Bonn (Rhein)")
    numbers = spark.createDataFrame([("12a", True), ("1-3", False), ("123456", False), ("7", True)], "n string, want boolean")
    assert all(r.got == r.want for r in numbers.select(sampling.plain_number(F.col("n")).alias("got"), "want").collect())


def test_queries_by_kind(spark):
    cities = [(52.5, 13.4), (48.1, 11.6)]
    rows = spark.createDataFrame([(1, "Musterstadt", "Anderstadt (Nord)", 48.2, 11.5, "small"), (2, "Au", "Ober Au", 52.4, 13.3, "large")], "id long, name string, city string, lat double, lon double, size string")
    got = {(r.id, r.category): r for r in sampling.town_queries(rows, cities).collect()}
    assert set(got) == {(1, "town.small.far"), (1, "town.small.near"), (1, "town.typing.far"), (1, "town.typo.far"), (2, "town.large.far"), (2, "town.large.near")}
    assert got[1, "town.typing.far"].query == "Musterst" and sorted(got[1, "town.typo.far"].query) == sorted("Musterstadt")
    assert (got[1, "town.small.far"].lat, got[2, "town.large.far"].lat) == (52.5, 48.1) and abs(got[1, "town.small.near"].lat - 48.2) < 0.1
    assert {r.category: r.query for r in sampling.district_queries(rows, cities).where("id = 1").collect()} == {"district.city.far": "Musterstadt Anderstadt", "district.alone.near": "Musterstadt"}
    assert {r.category for r in sampling.street_queries(rows, cities).where("id = 1").collect()} == {"street.city.far", "street.alone.near", "street.typing.far"}


def test_town_sizes(spark):
    towns = spark.range(400).select(F.concat(F.lit("t"), "id").alias("name"), (F.col("id") / 10.0).alias("lat"), F.lit(0.0).alias("lon"), (F.col("id") * 10).cast("int").alias("importance"))
    n = {r["size"]: r["count"] for r in sampling.town_sizes(towns.union(towns)).groupBy("size").count().collect()}
    assert n == {"large": 45, "medium": 35, "small": 320}


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumns({"a": F.col("id") % 7, "b": F.lit("x")}).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("a = 3").select("id")
    assert "EqualTo(a,3)" in plans.pushed_filters(df)[0] and "b:string" not in plans.read_columns(df)[0] and plans.operators(df)["FileScan"] == 1


def test_entry_works_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"and_query", "house_to_street"} <= names
    assert entry._optional("waymark.llm.not_there") is None and entry._optional("not_there.at_all") is None


@pytest.mark.parametrize("name", ["and_query", "segment_merge", "ring_semi_join"])
def test_queries_run_on_small_tables(spark, tmp_path, name):
    import __spark_entry__ as entry

    part = spark.range(0, 120).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", F.element_at(F.array(F.lit("red"), F.lit("old")), (F.col("id") % 2 + 1).cast("int")), F.lit("ring")).alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert entry.queries()[name](spark, str(tmp_path)).count() > 0
