"""The shared test tables read as places, streets and houses, so that operators have something to work on beside a dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ("DE", "AT", "CH", "FR", "PL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as street records: few names, towns and postcodes, so that segments merge; six by six cells."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dump_order"), F.lit(0).alias("entry_no"), F.lit(5).alias("kind"), F.col("p_name").alias("name"), F.concat(F.lit("NATION_"), (k % 5).cast("string")).alias("city"),
        F.when(k % 11 == 0, None).otherwise((10000 + k % 3).cast("string")).alias("postcode"), F.lit(None).cast("string").alias("house"), F.element_at(F.array(*map(F.lit, COUNTRIES)), (k % 5 + 1).cast("int")).alias("country"),
        ((F.col("p_size") * 1000 + k) % 65536).cast("int").alias("importance"), F.lit(True).alias("has_point"), (480_000_000 + (k * 7919) % 40 * 150_000).cast("int").alias("lat_e7"), (100_000_000 + (k * 104729) % 40 * 150_000).cast("int").alias("lon_e7"),
        F.lit(0).alias("role"), F.array().cast("array<struct<tag:string,name:string,city:string>>").alias("variants"),
        F.filter(F.array(F.col("p_name"), F.concat(F.lit("NATION_"), (k % 5).cast("string")), F.when(k % 11 != 0, (10000 + k % 3).cast("string"))), lambda x: x.isNotNull()).alias("texts"),
    )


def towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settlement a nation (of its first supplier) and its customers as boundaries, some within reach of it."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    settled = first.select((F.col("k") + 1_000_000_000).alias("dump_order"), F.col("s_nationkey").alias("nation"), F.lit(1).alias("role"), F.lit(4).alias("kind"), F.lit(0).alias("away"))
    land = c.select(F.col("c_custkey").alias("dump_order"), F.col("c_nationkey").alias("nation"), F.lit(2).alias("role"), F.lit(3).alias("kind"), (F.col("c_custkey") % 10 * 100_000).cast("int").alias("away"))
    rows = settled.unionByName(land)
    return rows.select(
        "dump_order", F.lit(0).alias("entry_no"), F.concat(F.lit("NATION_"), F.col("nation").cast("string")).alias("name"), F.when(F.col("role") == 1, F.concat(F.lit("C"), F.col("nation").cast("string"))).alias("city"), F.lit(None).cast("string").alias("postcode"),
        "kind", "role", F.lit(True).alias("has_point"), (400_000_000 + F.col("nation") * 1_000_000 + F.col("away")).cast("int").alias("lat_e7"), (50_000_000 + F.col("nation") * 1_000_000).cast("int").alias("lon_e7"),
    )


def house_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as houses on the street of their part: plain numbers, suffixes and ranges; some in a postcode or town the street doesn't have."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    p = place_src(spark, sf_dir).select(F.col("dump_order").alias("l_partkey"), "name", "city", "postcode", "lat_e7", "lon_e7")
    n = F.col("l_linenumber").cast("string")
    number = F.when(F.col("l_linestatus") == "F", F.concat(n, F.lower("l_returnflag"))).when(F.col("l_linenumber") % 2 == 0, F.concat(n, F.lit("-"), (F.col("l_linenumber") + 2).cast("string"))).otherwise(n)
    o = F.col("l_orderkey")
    return li.join(p, "l_partkey").select(
        (F.col("l_partkey") * 10_000_000_000 + o * 10 + F.col("l_linenumber")).alias("house_id"), F.col("name").alias("street"), F.when(o % 13 == 0, "ELSEWHERE").otherwise(F.col("city")).alias("city"),
        F.when(o % 7 == 0, "99999").when(o % 5 == 0, None).otherwise(F.col("postcode")).alias("postcode"), number.alias("number"),
        F.when(o % 17 != 0, F.col("lat_e7") + (F.col("l_linenumber") * 900).cast("int")).alias("lat_e7"), F.when(o % 17 != 0, F.col("lon_e7")).alias("lon_e7"),
    )


# The same for DuckDB.
PLACE_SQL = """
place as (
  select p_partkey as dump_order, p_name as name, 'NATION_' || (p_partkey % 5) as city,
         case when p_partkey % 11 = 0 then null else (10000 + p_partkey % 3)::varchar end as postcode,
         ((p_size * 1000 + p_partkey) % 65536)::int as importance,
         480000000 + (p_partkey * 7919) % 40 * 150000 as lat_e7, 100000000 + (p_partkey * 104729) % 40 * 150000 as lon_e7,
         ['DE', 'AT', 'CH', 'FR', 'PL'][(p_partkey % 5 + 1)::int] as country
  from part
)"""
HOUSE_SQL = PLACE_SQL + """,
house as (
  select l_partkey * 10000000000 + l_orderkey * 10 + l_linenumber as house_id, p.name as street, case when l_orderkey % 13 = 0 then 'ELSEWHERE' else p.city end as city,
         case when l_orderkey % 7 = 0 then '99999' when l_orderkey % 5 = 0 then null else p.postcode end as postcode,
         case when l_linestatus = 'F' then l_linenumber || lower(l_returnflag) when l_linenumber % 2 = 0 then l_linenumber || '-' || (l_linenumber + 2) else l_linenumber::varchar end as number,
         case when l_orderkey % 17 <> 0 then p.lat_e7 + l_linenumber * 900 end as lat_e7, case when l_orderkey % 17 <> 0 then p.lon_e7 end as lon_e7
  from lineitem join place p on l_partkey = p.dump_order
)"""
STREET_SQL = """,
piece as (
  select name, city, postcode, (sum(lat_e7) // count(*))::bigint as lat_e7, (sum(lon_e7) // count(*))::bigint as lon_e7, max(importance) as importance, count(*) as segments, min(dump_order) as first
  from place group by name, city, postcode
),
street as (select *, row_number() over (order by name, city, postcode nulls last) - 1 as doc_id from piece)"""
