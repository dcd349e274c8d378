"""Positions of house numbers that no house has, on the line between their neighbours, and how far off they would be for houses that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, house


def _valued(houses: DataFrame) -> DataFrame:
    """Of houses(doc_id, number, lat_e7, lon_e7) those with a point and a leading value v, and their order on the street."""
    rows = houses.where("lat_e7 is not null").withColumn("v", house.leading(F.col("number"))).where("v is not null")
    return rows.withColumn("place", F.struct("number", "lat_e7", "lon_e7"))


def estimates(houses: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, number, lat_e7, lon_e7 of each of asked(doc_id, number) that can be estimated: an aggregate a number, over the houses of its side of the street."""
    # Equal houses are one before their numbers are read (by way of n, so that no filter on v goes below the aggregate); of a value only the first house counts.
    once = houses.where("lat_e7 is not null").groupBy("doc_id", "number", "lat_e7", "lon_e7").agg(F.count("*").alias("n"))
    rows = once.withColumn("v", F.when(F.col("n") > 0, house.leading(F.col("number")))).where("v is not null").withColumn("place", F.struct("number", "lat_e7", "lon_e7"))
    rows = rows.groupBy("doc_id", "v").agg(F.min("place").alias("place")).select("doc_id", "v", "place", "place.lat_e7", "place.lon_e7")
    rows = rows.select("doc_id", F.pmod("v", F.lit(2)).alias("side"), F.struct("v", "lat_e7", "lon_e7").alias("h"), "place")
    want = asked.where("number > 0").select("doc_id", F.col("number").alias("want"), F.pmod("number", F.lit(2)).alias("side")).distinct()
    both = want.join(rows, ["doc_id", "side"]).groupBy("doc_id", "want").agg(
        F.min_by("h", F.when(F.col("h.v") <= F.col("want"), F.struct(-F.col("h.v"), "place"))).alias("below"), F.min_by("h", F.when(F.col("h.v") >= F.col("want"), F.struct("h.v", "place"))).alias("above")
    )
    at = house.between(F.col("below"), F.col("above"), F.col("want"))
    return both.select("doc_id", F.col("want").alias("number"), at.alias("at")).where("at is not null").select("doc_id", "number", "at.lat_e7", "at.lon_e7")


def left_out(houses: DataFrame) -> DataFrame:
    """doc_id, number, v, estimated and metres: each house estimated from the others of its street.

    Neighbours are the nearest values on the same side; where another house has the same value, that one is both. Values of a street are few, and their neighbours come from a window over values, not houses.
    """
    rows = _valued(houses)
    first = F.sort_array(F.collect_list(F.struct("place", "lat_e7", "lon_e7")))
    values = rows.groupBy("doc_id", "v").agg(F.slice(first, 1, 2).alias("two"))
    side = Window.partitionBy("doc_id", F.pmod("v", F.lit(2))).orderBy("v")
    spot = lambda h, v: F.struct(v.alias("v"), h["lat_e7"].alias("lat_e7"), h["lon_e7"].alias("lon_e7"))
    own = spot(F.element_at("two", 1), F.col("v"))
    values = values.withColumn("before", F.lag(own).over(side)).withColumn("after", F.lead(own).over(side)).withColumnRenamed("v", "_v")
    # Of equal houses all but one are left in.
    numbered = rows.withColumn("same", F.row_number().over(Window.partitionBy("doc_id", "v").orderBy("place")))
    both = numbered.join(values.withColumnRenamed("doc_id", "_d"), (F.col("doc_id") == F.col("_d")) & (F.col("v") == F.col("_v")))
    twin = F.when(F.size("two") > 1, F.when(F.col("same") == 1, F.element_at("two", 2)).otherwise(F.element_at("two", 1)))
    low, high = (F.coalesce(F.when(twin.isNotNull(), spot(twin, F.col("v"))), F.col(c)) for c in ("before", "after"))
    at = house.between(low, high, F.col("v"))
    out = both.where("v > 0").withColumn("at", at)
    return out.select("doc_id", "number", "v", F.col("at").isNotNull().alias("estimated"), geo.metres(F.col("lat_e7"), F.col("lon_e7"), F.col("at.lat_e7"), F.col("at.lon_e7")).alias("metres"))
