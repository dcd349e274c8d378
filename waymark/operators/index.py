"""An index: tables of documents, words, postings, houses and other names, as Parquet with a manifest that is written last."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from waymark.functions import house, text
from waymark.operators import build, search
from waymark.sources import dump

FORMAT = 2
TABLES = ("documents", "words", "postings", "houses", "variants")


class IndexError_(ValueError):
    """An index that can't be opened."""


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, the warehouse, or on a local master a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="waymark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/waymark-work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stager(spark: SparkSession):
    """A function that writes a table to the shared work folder and reads it again."""

    def stage(df: DataFrame) -> DataFrame:
        path = f"{work_dir(spark)}/waymark/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return stage


def build_index(places: DataFrame, path: str, languages: list[str]) -> GeoIndex:
    """Builds an index of a table of places and writes it."""
    spark = places.sparkSession
    stage = stager(spark)
    recs = build.records(places)
    docs = stage(build.documents(recs, stage))
    members = stage(build.assigned(docs))
    country = recs.select("dump_order", "entry_no", F.lower("country").alias("c")).join(members, ["dump_order", "entry_no"]).groupBy("doc_id").agg(F.min("c").alias("country"))
    met = Observation()
    # Staged, so that records of one document with the same texts and marks are one before their words are read.
    alike = stage(build.alike(recs, members))
    posts = stage(build.alike_words(alike).observe(met, F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).select("word", "doc_id").distinct())
    held = posts.groupBy("doc_id").agg(F.collect_list("word").alias("words"))
    whole = docs.drop("recs", "country").join(country, "doc_id", "left").join(held, "doc_id", "left").withColumns({"words": F.coalesce("words", F.array().cast("array<string>")), "name_words": text.distinct_words(F.col("name")), "city_words": text.distinct_words(F.col("city"))})
    keys = build.streets(recs, members)
    doors = stage(build.houses(places, keys, docs))
    out = {
        "documents": whole.sort("doc_id"),
        "words": build.vocabulary(posts).sort("word"),
        "postings": posts.repartitionByRange("word").sortWithinPartitions("word", "doc_id"),
        "houses": house.read(doors.where("doc_id is not null").select("doc_id", "number", "lat_e7", "lon_e7")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "number", "lat_e7", "lon_e7"),
        "variants": build.variants(recs, members).sort("tag", "doc_id"),
    }
    rows = {}
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name] = spark.read.parquet(f"{path}/{name}").count()
    counters = build.house_counters(doors).first().asDict()
    manifest = {"format": FORMAT, "languages": languages, "rows": rows, "houses": counters, "terms": met.get["terms"]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return GeoIndex.open(spark, path)


def build_dump(spark: SparkSession, source: str, path: str, languages: str = "de", cache: str | None = None) -> GeoIndex:
    """Builds an index of a dump of JSON lines. cache: a folder that keeps the places read, for builds to come of the same files and languages."""
    tags = dump.languages(languages)
    if cache is None:
        return build_index(stager(spark)(dump.places(dump.read_lines(spark, source), tags)), path, tags)
    stamp = dump.stamp(spark, source, tags)
    places = dump.staged(spark, cache, stamp)
    if places is None:
        places = dump.stage(dump.places(dump.read_lines(spark, source), tags), cache, stamp)
    return build_index(places, path, tags)


class GeoIndex:
    """An opened index."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.documents, self.words, self.postings, self.houses, self.variants = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
        self.stage = stager(spark)
        self._countries = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GeoIndex:
        row = spark.read.text(f"{path}/manifest").first()
        try:
            manifest = json.loads(row[0])
        except (TypeError, ValueError) as e:
            raise IndexError_(f"no manifest in {path}") from e
        if manifest.get("format") != FORMAT:
            raise IndexError_(f"format {manifest.get('format')} isn't {FORMAT}")
        return cls(spark, path, manifest)

    @property
    def languages(self) -> list[str]:
        return self.manifest["languages"]

    def info(self) -> dict:
        return {**self.manifest["rows"], "terms": self.manifest["terms"], "format": self.manifest["format"], "languages": self.languages}

    def countries(self) -> list[tuple[str, list[list[str]]]]:
        """Country words with the spellings of the country, in words; the world has a few hundred."""
        if self._countries is None:
            marked = self.postings.where("word = '#*'").select("doc_id")
            names = self.documents.join(marked, "doc_id").where("kind = 1 and country is not null").select("country", "name", "doc_id")
            other = self.variants.join(names.select("doc_id", "country"), "doc_id").select("country", "name")
            found: dict[str, list[list[str]]] = {}
            for r in names.select("country", "name").union(other).where("name is not null").collect():
                found.setdefault("#" + r["country"], []).append([t.word for t in text.tokenize(r["name"]) if not t.part and t.grp < 64])
            self._countries = sorted(found.items())
        return self._countries

    def search_df(self, queries: DataFrame) -> DataFrame:
        """Answers of queries(query_id, text, prefix_last, lat, lon, lang, limit)."""
        return search.search(self, queries)

    def search_rows(self, query: str, prefix_last: bool = False, limit: int = 10, position: tuple[float, float] | None = None, language: str | None = None) -> DataFrame:
        if language is not None and language not in self.languages:
            raise ValueError(f"unknown language: {language}")
        if position and not (-90 <= position[0] <= 90 and -180 <= position[1] <= 180):
            raise ValueError("position out of range")
        lat, lon = position or (None, None)
        return self.search_df(self.spark.createDataFrame([(0, query, prefix_last, lat, lon, language, limit)], search._QUERY))

    def search(self, query: str, **how) -> list[dict]:
        return [r.asDict() for r in self.search_rows(query, **how).orderBy("rank").collect()]

    def search_json(self, query: str, **how) -> str:
        """The answers as one JSON text, as `search.as_json` writes them."""
        first = search.as_json(self.search_rows(query, **how)).first()
        return first["json"] if first else "[]"

    def stats_df(self, queries: DataFrame) -> DataFrame:
        """Counts of how each of the queries was answered."""
        return search.stats(self, queries)

    def house_estimate(self, doc_id: int, number: int) -> tuple[int, int] | None:
        from waymark.functions import geo

        doors = [(r["number"], r["lat_e7"], r["lon_e7"]) for r in self.houses.where(F.col("doc_id") == doc_id).orderBy("number", "lat_e7", "lon_e7").collect()]
        return house.estimate(doors, number, lambda lat: geo.SHRINK[min(abs(lat) // 100_000_000, 9)])

    def close(self) -> None:
        self.documents = self.words = self.postings = self.houses = self.variants = None
