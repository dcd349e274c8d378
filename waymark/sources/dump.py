"""Dumps of places: JSON lines, also zstd-compressed, to one row a place; and that table staged for later builds.

A compressed file is one task to read, so the rows are dealt anew right after the scan; dump_order is taken before that.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo

# Place kinds by address_type, osm values of settlements and areas, most search texts and languages.
KINDS = {"house": 6, "street": 5, "city": 4, "county": 3, "state": 2, "country": 1, "district": 8, "locality": 9, "other": 7}
SETTLEMENTS, AREAS = ("city", "town", "village"), (("place", "municipality"), ("boundary", "administrative"))
STREET, HOUSE, OTHER, CITY_KINDS, AREA_KINDS = 5, 6, 7, (4, 10, 11), (1, 2, 3, 4, 10, 11)
SETTLEMENT, AREA = 1, 2
MOST_TEXTS, MOST_LANGUAGES, TAG = 128, 32, 7

ENTRY = (
    "address_type string, name map<string,string>, address map<string,variant>, street string, postcode string, housenumber string, "
    "country_code string, importance double, centroid array<double>, osm_key string, osm_value string"
)
LINE = f"type string, content array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in ENTRY.split(', '))}>>"


def languages(text: str) -> list[str]:
    """Tags of a list such as `de,en`: lowered, each once, the first is the default."""
    out: list[str] = []
    for tag in text.replace(",", " ").split():
        tag = tag.lower()
        if len(tag.encode()) > TAG:
            raise ValueError(f"not a language tag: {tag}")
        if tag == "all":
            raise ValueError("languages are named one by one")
        if tag not in out:
            out.append(tag)
    if not out or len(out) > MOST_LANGUAGES:
        raise ValueError(f"1 to {MOST_LANGUAGES} languages are needed")
    return out


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """line, dump_order of a dump; empty lines are passed over."""
    lines = spark.read.text(path).withColumn("dump_order", F.monotonically_increasing_id()).where("length(value) > 0").withColumnRenamed("value", "line")
    return lines.repartition(partitions or spark.sparkContext.defaultParallelism)


def entries(lines: DataFrame) -> DataFrame:
    """dump_order and one struct e a content entry of lines(line, dump_order); broken JSON fails, other roots are passed over."""
    parsed = lines.select("dump_order", F.from_json("line", LINE, {"mode": "FAILFAST"}).alias("j")).where("j.type = 'Place'")
    return parsed.select("dump_order", F.posexplode("j.content").alias("entry_no", "e")).where("e is not null")


def kind(address_type: Column) -> Column:
    """The kind's number; an unknown or missing one fails."""
    table = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    found = F.when(address_type.isNotNull(), F.element_at(table, F.coalesce(address_type, F.lit("house"))))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown address_type: "), F.coalesce(address_type, F.lit("none")))).cast("int"))


def role(key: Column, value: Column) -> Column:
    area = F.lit(False)
    for k, v in AREAS:
        area = area | ((key == k) & (value == v))
    return F.coalesce(F.when((key == "place") & value.isin(*SETTLEMENTS), SETTLEMENT).when(area, AREA), F.lit(0))


def place(e: Column, langs: list[str]) -> dict[str, Column]:
    """The columns of a place by name."""
    default, others = langs[0], langs[1:]
    text = lambda k: e["address"][k].try_cast("string")
    names = e["name"]
    own = F.coalesce(names[f"name:{default}"], names["name"])
    house = F.coalesce(text("housenumber"), e["housenumber"])
    k = kind(e["address_type"])
    postcode = F.coalesce(e["postcode"], text("postcode"))
    street = F.when(k == STREET, own).otherwise(F.coalesce(text(f"street:{default}"), text("street"), e["street"]))
    city = F.when(k.isin(*CITY_KINDS), own).otherwise(F.coalesce(text(f"city:{default}"), text("city")))
    indexed = (k != HOUSE) & e["housenumber"].isNull()
    held = F.array(*map(F.lit, langs))
    fits = lambda key: ~F.contains(key, F.lit(":")) | F.array_contains(held, F.substring_index(key, ":", -1))
    plain = F.map_filter(F.coalesce(e["address"], F.create_map().cast("map<string,variant>")), lambda key, v: (key != "other") & (key != "housenumber") & fits(key))
    values = F.filter(F.transform(F.map_values(plain), lambda v: v.try_cast("string")), lambda x: x.isNotNull())
    rest = F.coalesce(e["address"]["other"].try_cast("array<string>"), F.array().cast("array<string>"))
    all_names = F.filter(F.coalesce(F.map_values(names), F.array().cast("array<string>")), lambda x: x.isNotNull())
    texts = F.array_distinct(F.filter(F.concat(values, rest, all_names, F.array(postcode)), lambda x: x.isNotNull() & ~x.eqNullSafe(house)))
    variant = lambda tag: F.struct(F.lit(tag).alias("tag"), names[f"name:{tag}"].alias("name"), F.coalesce(text(f"city:{tag}"), F.when(k.isin(*CITY_KINDS), names[f"name:{tag}"])).alias("city"))
    variants = F.filter(F.array(*map(variant, others)) if others else F.array().cast("array<struct<tag:string,name:string,city:string>>"), lambda v: v["name"].isNotNull() | v["city"].isNotNull())
    point = F.coalesce(F.size(e["centroid"]) == 2, F.lit(False))
    return {
        "kind": k, "name": own, "street": street, "city": city, "postcode": postcode, "house": house, "country": e["country_code"],
        "importance": geo.importance(e["importance"]), "has_point": point,
        "lat_e7": F.when(point, geo.e7(F.coalesce(e["centroid"][1], F.lit(0.0)))), "lon_e7": F.when(point, geo.e7(F.coalesce(e["centroid"][0], F.lit(0.0)))),
        "role": role(e["osm_key"], e["osm_value"]), "variants": variants,
        "texts": F.when(indexed, F.slice(texts, 1, MOST_TEXTS)).otherwise(F.array().cast("array<string>")), "texts_dropped": F.when(indexed, F.greatest(F.size(texts) - MOST_TEXTS, F.lit(0))).otherwise(0),
    }


def places(lines: DataFrame, langs: list[str]) -> DataFrame:
    """One row a place, but those of kind `other` without a house number."""
    rows = entries(lines)
    return rows.select("dump_order", "entry_no", *[c.alias(n) for n, c in place(rows["e"], langs).items()]).where(f"kind <> {OTHER} or house is not null")


def census(rows: DataFrame) -> DataFrame:
    """Counts of a table of places by kind."""
    return rows.groupBy("kind").agg(F.count("*").alias("places"), F.count_if(F.col("house").isNotNull()).alias("addresses"), F.sum(F.size("texts")).cast("long").alias("texts"), F.sum("texts_dropped").cast("long").alias("dropped"), F.count_if(~F.col("has_point")).alias("pointless"))


def line_census(lines: DataFrame) -> DataFrame:
    """One row: lines, those that aren't JSON or have no content, those of other types than places, and the entries of places."""
    j = F.from_json("line", LINE + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.select(j.alias("j"))
    place = F.coalesce(F.col("j.type") == "Place", F.lit(False))
    bad = F.col("j.broken").isNotNull() | place & F.col("j.content").isNull()
    return rows.agg(F.count("*").alias("lines"), F.count_if(bad).alias("invalid"), F.count_if(~bad & ~place).alias("other"), F.coalesce(F.sum(F.when(~bad & place, F.size("j.content"))), F.lit(0)).cast("long").alias("entries"))


def as_json(rows: DataFrame) -> DataFrame:
    """json: each place as one line, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def stamp(spark: SparkSession, path: str, tags: list[str]) -> dict:
    """What tells a dump from another: its files with their sizes and times, and the languages read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return {"files": sorted([f.getPath().toString(), f.getLen(), f.getModificationTime()] for f in found), "languages": tags}


def stage(rows: DataFrame, path: str, stamp: dict) -> DataFrame:
    """Writes places with the stamp of what they came from, the stamp last."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/places")
    spark.createDataFrame([(json.dumps(stamp, sort_keys=True),)], "stamp string").coalesce(1).write.mode("overwrite").text(f"{path}/stamp")
    return spark.read.parquet(f"{path}/places")


def staged(spark: SparkSession, path: str, stamp: dict) -> DataFrame | None:
    """The places staged from the same source, or None."""
    try:
        found = spark.read.text(f"{path}/stamp").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{path}/places") if found and found[0] == json.dumps(stamp, sort_keys=True) else None
