"""Evaluation: queries with the places they should find, ranks of those, and a report by category, group and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators.index import stager

# Columns of a query file, most answers looked at, radius of the Earth in metres, widest reach of the relaxed test.
COLUMNS = ("category", "query", "prefix", "lat", "lon", "lang", "limit", "expect_name", "expect_number", "expect_street", "expect_city", "expect_postcode", "expect_lat", "expect_lon", "radius_m", "context")
MOST, EARTH, RELAXED_M = 10, 6_371_000.0, 25_000.0


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated query file with a header; `#` begins a comment; blanks at an end of a query stand for themselves.

    A row that can't be read stops the run, so that a broken file doesn't quietly shrink the sample: category, query and something expected must be there, prefix
    is 0 or 1, degrees come in pairs and are finite, a limit is 1 or more, and an expected place has a radius.
    """
    rows = spark.read.csv(path, sep="\t", comment="#", header=True, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False, quote="")
    if missing := {"category", "query"} - set(rows.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))} in {path}")
    for c in COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in COLUMNS})
    given = {c: F.col(c).isNotNull() for c in COLUMNS}
    finite = lambda c: F.coalesce(F.abs(F.col(c).try_cast("double")) < float("inf"), F.lit(False))  # noqa: E731  nan is above infinity
    limit = F.col("limit").try_cast("double")
    ok = given["category"] & given["query"] & (~given["prefix"] | F.col("prefix").isin("0", "1")) & (~given["limit"] | F.coalesce((limit >= 1) & (limit < float("inf")), F.lit(False)))
    ok &= (finite("lat") == finite("lon")) & (finite("expect_lat") == finite("expect_lon")) & (~finite("expect_lat") | finite("radius_m"))
    ok &= finite("expect_lat") | given["expect_name"] | given["expect_number"] | given["expect_street"] | given["expect_city"] | given["expect_postcode"]
    shown = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in ("category", "query")])
    rows = rows.withColumn("category", F.when(ok, F.col("category")).otherwise(F.raise_error(F.concat(F.lit("a row of the query file can't be read: "), shown))))
    rows = rows.withColumns({c: F.when(finite(c), F.col(c).try_cast("double")) for c in ("lat", "lon", "expect_lat", "expect_lon", "radius_m")})
    return rows.withColumns({"query_id": F.monotonically_increasing_id(), "prefix": F.coalesce(F.col("prefix").cast("int"), F.lit(1)), "limit": F.least(F.coalesce(limit, F.lit(1.0)), F.lit(float(MOST))).cast("int")})


def equals(value: Column, alternatives: Column) -> Column:
    """Whether a text is one of the alternatives, loosely."""
    return F.exists(F.split(alternatives, r"\|"), lambda a: text.loose(a) == text.loose(value))


def town(value: Column, alternatives: Column) -> Column:
    """Whether all words of one side stand in the other; empty texts never match."""
    words = lambda c: F.filter(F.split(text.loose(c), " "), lambda w: w != "")
    own = words(value)

    def fits(a: Column) -> Column:
        b = words(a)
        return (F.size(own) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(own, b)) == 0) | (F.size(F.array_except(b, own)) == 0))

    return F.exists(F.split(alternatives, r"\|"), fits)


def number(value: Column, alternatives: Column) -> Column:
    plain = lambda c: F.substring(F.lower(F.replace(c, F.lit(" "), F.lit(""))), 1, 31)
    return F.exists(F.split(alternatives, r"\|"), lambda a: plain(a) == plain(value))


def door(name: Column, number: Column, alternatives: Column) -> Column:
    """Whether name and number together are one of the alternatives."""
    return F.coalesce(equals(F.concat_ws(" ", name, number), alternatives) & name.isNotNull() & number.isNotNull(), F.lit(False))


def postcode(value: Column, alternatives: Column) -> Column:
    return F.size(F.array_intersect(F.split(value, ";"), F.split(alternatives, r"\|"))) > 0


def metres(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a flat Earth."""
    x = F.radians(lon2 - lon) * F.cos(F.radians((lat + lat2) / 2))
    y = F.radians(lat2 - lat)
    return F.sqrt(x * x + y * y) * EARTH


def expected(relaxed: bool = False) -> Column:
    """Whether an answer (a) is the one a row (e) expects: all that is given holds; relaxed: beside a name, town and postcode don't count, and the reach is wider."""
    col = F.col
    named = col("expect_name").isNotNull() | col("expect_street").isNotNull() if relaxed else F.lit(False)
    given = lambda c, test: F.when(col(c).isNull(), True).otherwise(F.coalesce(test, F.lit(False)))
    ok = given("expect_name", F.coalesce(equals(col("a.name"), col("expect_name")), F.lit(False)) | door(col("a.name"), col("a.number"), col("expect_name")))
    ok &= given("expect_number", number(col("a.number"), col("expect_number")))
    ok &= given("expect_street", equals(col("a.name"), col("expect_street")))
    ok &= F.when(named, True).otherwise(given("expect_city", town(F.coalesce("a.city", "a.name"), col("expect_city"))))
    ok &= F.when(named, True).otherwise(given("expect_postcode", postcode(col("a.postcode"), col("expect_postcode"))))
    reach = F.greatest(10 * col("radius_m"), F.lit(RELAXED_M)) if relaxed else col("radius_m")
    return ok & given("expect_lat", metres(col("a.latitude"), col("a.longitude"), col("expect_lat"), col("expect_lon")) <= reach)


def ranks(rows: DataFrame, answers: DataFrame, relaxed: bool = False) -> DataFrame:
    """rows with rank: of the first answer that is expected, 0 if none."""
    both = rows.join(answers.select("query_id", "rank", F.struct("name", "number", "city", "postcode", "latitude", "longitude").alias("a")), "query_id")
    hit = both.where(expected(relaxed)).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return rows.join(hit, "query_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def report(ranked: DataFrame) -> DataFrame:
    """n, absent, passed, top1, top3, top10 and mean reciprocal rank of ranked(category, rank, limit, absent): by category, by group (before the first dot), overall."""
    rows = ranked.select("category", F.substring_index("category", ".", 1).alias("grp"), "rank", F.least("limit", F.lit(MOST)).alias("limit"), "absent")
    here = ~F.col("absent")
    hit = lambda k: F.count_if(here & F.col("rank").between(1, k))
    sums = rows.groupingSets([["category"], ["grp"], []], "category", "grp").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count_if("absent").alias("absent"), F.count_if(here & (F.col("rank") >= 1) & (F.col("rank") <= F.col("limit"))).alias("passed"),
        hit(1).alias("top1"), hit(3).alias("top3"), hit(10).alias("top10"), F.avg(F.when(here, F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0))).alias("mrr"),
    )
    level = F.when(F.col("gid") == 1, "category").when(F.col("gid") == 2, "group").otherwise("all")
    return sums.select(level.alias("level"), F.coalesce("category", "grp", F.lit("all")).alias("label"), "n", "absent", "passed", "top1", "top3", "top10", "mrr")


def latencies(rows: DataFrame, value: str) -> DataFrame:
    """Middle, 95th percentile and maximum by position in order: element n/2 and n*95/100 from 0.

    Values are counted and dealt to sorted ranges; ranges' sums give each its offset, so only sums of ranges meet in one task.
    """
    counts = rows.select(F.col(value).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("k"))
    ranged = stager(rows.sparkSession)(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("k").alias("held"))
    sums = sums.select("part", F.sum("held").over(Window.orderBy("part")).alias("upto_part"), "held", F.sum("held").over(Window.partitionBy()).alias("n"))
    within = F.sum("k").over(Window.partitionBy("part").orderBy("v"))
    order = ranged.join(F.broadcast(sums), "part").withColumn("upto", F.col("upto_part") - F.col("held") + within)  # a row a range
    at = lambda num, den: F.min(F.when(F.col("upto") > F.floor(F.col("n") * num / den), F.col("v")))
    return order.agg(at(1, 2).alias("p50"), at(95, 100).alias("p95"), F.max("v").alias("worst"))


def failures(ranked: DataFrame, answers: DataFrame, most: int = 3) -> DataFrame:
    """category, query, absent, rank, expected and answers (lines for a reader, the first few) of the queries that didn't pass."""
    rows = ranked.where(~((F.col("rank") >= 1) & (F.col("rank") <= F.least("limit", F.lit(MOST)))))
    part = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(label + " "), F.col(c)))
    place = F.when(F.col("expect_lat").isNotNull(), F.format_string("within %.0f m of %.5f,%.5f", "radius_m", "expect_lat", "expect_lon"))
    want = F.concat_ws(" ", part("name", "expect_name"), part("street", "expect_street"), part("number", "expect_number"), part("postcode", "expect_postcode"), part("town", "expect_city"), place)
    both = rows.join(answers.where(F.col("rank") <= most).select("query_id", F.col("rank").alias("no"), "name", "number", F.col("postcode").alias("code"), "city", "latitude", "longitude", "kind"), "query_id", "left")
    away = F.when(F.col("expect_lat").isNotNull() & F.col("latitude").isNotNull(), F.format_string(", %.1f km from the expected place", metres(F.col("latitude"), F.col("longitude"), F.col("expect_lat"), F.col("expect_lon")) / 1000.0))
    line = F.concat(F.col("no").cast("string"), F.lit(". "), F.concat_ws(" ", F.coalesce("name", F.lit("-")), "number"), F.lit(", "), F.concat_ws(" ", "code", F.coalesce("city", F.lit("-"))), F.coalesce(away, F.lit("")), F.format_string(" (kind %d)", "kind"))
    shown = F.transform(F.sort_array(F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", line.alias("line"))))), lambda x: x["line"])
    return both.groupBy("query_id", "category", "query", "absent", "rank", want.alias("expected")).agg(shown.alias("answers")).drop("query_id")


def evaluate(index, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked rows, report, failures): searches every row, and tells rows whose place isn't in the index by a relaxed search for what is expected."""
    asked = rows.select("query_id", F.col("query").alias("text"), (F.col("prefix") == 1).alias("prefix_last"), "lat", "lon", "lang", F.lit(MOST).alias("limit"))
    answers = index.stage(index.search_df(asked))
    found = index.stage(ranks(rows, answers))
    missed = found.where("rank = 0")
    probe = missed.select("query_id", F.concat(F.concat_ws(" ", *[F.substring_index(F.coalesce(c, F.lit("")), "|", 1) for c in ("expect_street", "expect_name", "expect_number", "expect_postcode", "expect_city")]), F.lit(" ")).alias("text"), F.lit(False).alias("prefix_last"), F.col("expect_lat").alias("lat"), F.col("expect_lon").alias("lon"), "lang", F.lit(256).alias("limit"))
    there = ranks(missed.drop("rank"), index.search_df(probe), relaxed=True).select("query_id", (F.col("rank") == 0).alias("absent"))
    ranked = found.join(there, "query_id", "left").withColumn("absent", F.coalesce("absent", F.lit(False)))
    return ranked, report(ranked), failures(ranked, answers)
