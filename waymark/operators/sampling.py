"""Drawing evaluation queries from places: samples by hash, sizes of towns, and ways people write an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo

# Towns counted as large at least, share of a last word typed, letters from which it is cut, km of a far viewpoint.
LARGE, TYPED, CUT_FROM, FAR_KM = 45, 0.6, 6, 150.0
RADIUS = {"address": 150.0, "street": 3000.0, "town": 8000.0, "district": 3000.0}  # metres around the expected place


def sample(rows: DataFrame, key: str, k: int, seed: int = 12) -> DataFrame:
    """k rows, the same at every run: those with the least hash of their key."""
    return rows.withColumn("_h", F.xxhash64(key, F.lit(seed))).orderBy("_h", key).limit(k).drop("_h")


def thinned(rows: DataFrame, share: float, key: str, seed: int = 12) -> DataFrame:
    """A share of the rows, by hash of their key."""
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def plain_number(number: Column) -> Column:
    """Digits and at most one letter, five characters in all."""
    return number.rlike("^[0-9]+[a-hA-H]?$") & (F.length(number) <= 5)


def town_sizes(towns: DataFrame) -> DataFrame:
    """towns(name, lat, lon, importance), each once a tenth of a degree (the heaviest), as large, medium or small."""
    spot = Window.partitionBy("name", F.round("lat", 1), F.round("lon", 1)).orderBy(F.desc("importance"))
    once = towns.withColumn("_r", F.row_number().over(spot)).where("_r = 1").drop("_r")
    # Ranks by weight over counts of weights, of which there are 65536 at most.
    n = once.groupBy("importance").agg(F.count("*").alias("c"))
    above = n.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("importance")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    large = F.greatest(F.lit(LARGE), F.floor(F.col("n") / 100))
    size = F.when(F.col("before") < large, "large").when(F.col("before") < F.floor(F.col("n") / 5), "medium").otherwise("small")
    return once.join(F.broadcast(above.select("importance", size.alias("size"))), "importance")


def abbreviated(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "(?i)stra(ß|ss)e", "str."), "(?i)platz", "pl.")


def without_umlauts(col: Column) -> Column:
    return F.replace(F.translate(col, "äöüÄÖÜ", "aouAOU"), F.lit("ß"), F.lit("ss"))


def still_typing(col: Column) -> Column:
    """The last word cut to 60 % of its letters, if it has six or more."""
    last = F.regexp_extract(col, r"(\S+)$", 1)
    kept = F.substr(last, F.lit(1), F.ceil(F.length(last) * TYPED).cast("int"))
    return F.when(F.length(last) >= CUT_FROM, F.concat(F.regexp_replace(col, r"\S+$", ""), kept)).otherwise(col)


def swapped(col: Column, seed: Column) -> Column:
    """Two neighbouring letters of the text swapped, by the seed."""
    i = (F.pmod(F.xxhash64(seed), F.greatest(F.length(col) - 2, F.lit(1))) + 1).cast("int")
    return F.when(F.length(col) >= 4, F.concat(F.substr(col, F.lit(1), i - 1), F.substr(col, i + 1, F.lit(1)), F.substr(col, i, F.lit(1)), F.substr(col, i + 2))).otherwise(col)


def spoken_town(col: Column) -> Column:
    """A town without what is in brackets or after a stroke."""
    return F.trim(F.regexp_replace(col, r"\s*[(/,].*$", ""))


def viewpoint(lat: Column, lon: Column, seed: Column, km: float) -> tuple[Column, Column]:
    """A point within so many km, by the seed."""
    u, v = ((F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(20001)) - 10000) / 10000.0 for i in (1, 2))
    reach = km / 111.195
    return lat + u * reach, lon + v * reach / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))


def km(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    return geo.metres(geo.e7(lat), geo.e7(lon), geo.e7(lat2), geo.e7(lon2)) / 1000.0


def far_viewpoint(lat: Column, lon: Column, seed: Column, cities: list[tuple[float, float]]) -> Column:
    """One of the cities that are FAR_KM away at least, by the seed: struct lat, lon, or null."""
    spots = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in cities])
    away = F.filter(spots, lambda c: km(lat, lon, c["lat"], c["lon"]) >= FAR_KM)
    return F.when(F.size(away) > 0, F.element_at(away, (F.pmod(F.xxhash64(seed, F.lit(7)), F.size(away)) + 1).cast("int")))


def _asked(rows: DataFrame, kinds: dict, name: str, radius: float, cities, more: dict | None = None) -> DataFrame:
    """rows(id, lat, lon) as queries of some kinds: category to (query, km of a near viewpoint or None for a far one); null queries and far ones without a city fall out."""
    seed = F.col("id").cast("string")
    far = far_viewpoint(F.col("lat"), F.col("lon"), seed, cities)

    def one(category, query, reach):
        at = far if reach is None else F.struct(*[c.alias(k) for c, k in zip(viewpoint(F.col("lat"), F.col("lon"), F.concat(seed, F.lit(category)), reach), ("lat", "lon"), strict=True)])
        return F.struct((category if isinstance(category, Column) else F.lit(category)).alias("category"), query.alias("query"), at.alias("at"))

    each = rows.select("*", F.explode(F.array(*[one(k, q, r) for k, (q, r) in kinds.items()])).alias("q")).where("q.query is not null and q.at is not null")
    extra = [c.alias(k) for k, c in (more or {}).items()]
    return each.select("id", "q.category", "q.query", F.lit(1).alias("prefix"), F.col("q.at.lat").alias("lat"), F.col("q.at.lon").alias("lon"), F.col(name).alias("expect_name"), *extra, F.col("lat").alias("expect_lat"), F.col("lon").alias("expect_lon"), F.lit(radius).alias("radius_m"))


def _cut(col: Column) -> Column:
    """A word still being typed: its first 70 % of letters, four at least, if it is one word of six or more."""
    kept = F.greatest(F.lit(4), F.ceil(F.length(col) * 0.7)).cast("int")
    return F.when((F.length(col) >= CUT_FROM) & ~F.contains(col, F.lit(" ")), F.substr(col, F.lit(1), kept))


def town_queries(rows: DataFrame, cities: list[tuple[float, float]]) -> DataFrame:
    """rows(id, name, lat, lon, size) as queries for towns: from afar and nearby, still typing, and with two letters swapped."""
    n = F.col("name")
    wrong = F.when(~F.contains(n, F.lit(" ")) & (F.length(n) >= 4), swapped(n, F.col("id").cast("string")))
    out = _asked(rows, {"town.far": (n, None), "town.near": (n, 5.0), "town.typing.far": (_cut(n), None), "town.typo.far": (wrong, None)}, "name", RADIUS["town"], cities, {"size": F.col("size")})
    plain = F.col("category").isin("town.far", "town.near")
    return out.withColumn("category", F.when(plain, F.concat(F.lit("town."), "size", F.substring("category", 5, 9))).otherwise(F.col("category"))).drop("size")


def district_queries(rows: DataFrame, cities: list[tuple[float, float]]) -> DataFrame:
    """rows(id, name, city, lat, lon) as queries for districts: with the town from afar, alone nearby."""
    return _asked(rows, {"district.city.far": (F.concat_ws(" ", "name", spoken_town(F.col("city"))), None), "district.alone.near": (F.col("name"), 3.0)}, "name", RADIUS["district"], cities)


def street_queries(rows: DataFrame, cities: list[tuple[float, float]]) -> DataFrame:
    """rows(id, name, city, lat, lon) as queries for streets: with the town from afar, alone nearby, with a town still being typed."""
    full = F.concat_ws(" ", "name", spoken_town(F.col("city")))
    typed = F.when(still_typing(full) != full, still_typing(full))
    return _asked(rows, {"street.city.far": (full, None), "street.alone.near": (F.col("name"), 0.5), "street.typing.far": (typed, None)}, "name", RADIUS["street"], cities)


def address_queries(rows: DataFrame) -> DataFrame:
    """rows(id, street, number, postcode, city, lat, lon) as queries: spellings of one address, with what each should find."""
    full = F.concat_ws(" ", F.col("street"), F.col("number"))
    kinds = {
        "address.full": F.concat_ws(" ", full, "postcode", "city"), "address.town_first": F.concat_ws(" ", F.col("city"), full), "address.comma": F.concat(full, F.lit(", "), F.col("city")), "address.abbreviated": F.concat_ws(" ", abbreviated(full), "city"),
        "address.plain": without_umlauts(F.concat_ws(" ", full, "city")), "address.typing": still_typing(F.concat_ws(" ", full, "city")), "address.swapped": F.concat_ws(" ", swapped(F.col("street"), F.col("id").cast("string")), "number", "city"), "street.town": F.concat_ws(" ", "street", "city"), "street.typing": still_typing(F.col("street")), "town": spoken_town(F.col("city")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), q.alias("query")) for k, q in kinds.items()]))
    return rows.select("id", each.alias("q"), "street", "number", "postcode", "city", "lat", "lon").select(
        "id", "q.category", "q.query", F.col("q.category").endswith("typing").cast("int").alias("prefix"), F.when(~F.col("q.category").startswith("town"), F.col("street")).alias("expect_street"),
        F.when(F.col("q.category").startswith("address"), F.col("number")).alias("expect_number"), F.when(F.col("q.category") != "street.typing", F.col("city")).alias("expect_city"),
    )

