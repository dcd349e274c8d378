import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, house, text

CASES = {
    "München": [("muenchen", 0, False, ""), ("munchen", 0, False, "")],
    "München": [("muenchen", 0, False, ""), ("munchen", 0, False, "")],
    "Straße": [("strasse", 0, False, "")],
    "GROẞE": [("grosse", 0, False, "")],
    "Sankt Peter-Ording": [("sankt", 0, False, ""), ("peter", 1, False, ""), ("ording", 2, False, "-")],
    "Superstr.": [("superstrasse", 0, False, ""), ("super", 0, True, ""), ("strasse", 0, True, "")],
    "St. Peter": [("sankt", 0, False, ""), ("peter", 1, False, ".")],
    "Marienpl.": [("marienplatz", 0, False, ""), ("marien", 0, True, ""), ("platz", 0, True, "")],
    "Leopoldstraße": [("leopoldstrasse", 0, False, ""), ("leopold", 0, True, ""), ("strasse", 0, True, "")],
    "Ǎnhuī": [("anhui", 0, False, "")],
    "Đà Nẵng": [("da", 0, False, ""), ("nang", 1, False, "")],
    "București": [("bucuresti", 0, False, "")],
    "ﬂughafen": [("flughafen", 0, False, "")],
    "北京": [("北京", 0, False, "")],
    "МОСКВА": [("москва", 0, False, "")],
    "Anderter Straße 1-3": [("anderter", 0, False, ""), ("strasse", 1, False, ""), ("1", 2, False, ""), ("3", 3, False, "-")],
    "12/1": [("12", 0, False, ""), ("1", 1, False, "/")],
    "5, 53111": [("5", 0, False, ""), ("53111", 1, False, ".")],
    "5 -/ 7": [("5", 0, False, ""), ("7", 1, False, ".")],
    "Bahnhofstraße Straße": [("bahnhofstrasse", 0, False, ""), ("bahnhof", 0, True, ""), ("strasse", 0, True, "")],
    "koppl": [("kopplatz", 0, False, ""), ("kop", 0, True, ""), ("platz", 0, True, "")],
    "Æøß Ĳssel Ǆ Ƕ": [("aeoss", 0, False, ""), ("ijssel", 1, False, ""), ("dz", 2, False, ""), ("hv", 3, False, "")],
    "": [],
    " - / ,": [],
}


@pytest.mark.parametrize("given", CASES)
def test_tokens_on_the_driver(given):
    assert [tuple(t) for t in text.tokenize(given)] == CASES[given]


def test_tokens_as_columns(spark):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "t string").select("t", text.words(F.col("t")).alias("w"))
    for r in df.collect():
        assert [tuple(x) for x in r.w] == CASES.get(r.t, [])


def test_most_tokens(spark):
    long = " ".join(f"w{i}" for i in range(100))
    assert len(text.tokenize(long)) == text.MOST_TOKENS == len(spark.createDataFrame([(long,)], "t string").select(text.words(F.col("t")).alias("w")).first().w)


def test_loose(spark):
    df = spark.createDataFrame([("  Älter-Weg,  Nº 5 ", "alter weg n 5"), ("STRASSE / Straße", "strasse strasse"), (None, "")], "a string, b string")
    assert all(r.x == r.b for r in df.select(text.loose(F.col("a")).alias("x"), "b").collect())


def test_cells_and_rings(spark):
    rows = [(900_000_000, 1_800_000_000), (-900_000_000, -1_800_000_000), (481_374_000, 115_755_000), (0, -1)]
    df = spark.createDataFrame(rows, "lat int, lon int")
    c = geo.cell(F.col("lat"), F.col("lon"))
    got = df.select(c.alias("c"), geo.cell_token(c).alias("t"), F.size(geo.ring(F.col("lat"), F.col("lon"))).alias("n")).collect()
    want = [1799 * 3600, 0, (481_374_000 + 900_000_000) // 1_000_000 * 3600 + (115_755_000 + 1_800_000_000) // 1_000_000, 900 * 3600 + 1799]
    assert [r.c for r in got] == want and [r.n for r in got] == [6, 6, 9, 9]
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    assert [r.t for r in got] == ["@" + "".join(digits[w // 36**i % 36] for i in range(5)) for w in want]


def test_distances(spark):
    rows = [(481_374_000, 115_755_000, 481_374_000, 115_756_000), (0, 1_799_999_999, 0, -1_799_999_999), (481_374_000, 115_755_000, 480_000_000, 110_000_000), (600_000_000, 0, 600_000_000, -7)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    d = geo.distance2(*map(F.col, "abcd"))
    for r in df.select("*", d.alias("d2"), geo.band(d).alias("band")).collect():
        assert (r.d2, r.band) == (geo.distance2_of(r.a, r.b, r.c, r.d), geo.band_of(r.d2))
    assert geo.distance2_of(0, 1_799_999_999, 0, -1_799_999_999) == 4
    assert spark.range(1).select(geo.distance2(F.lit(1), F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int"))).first()[0] == geo.FAR


def test_importance(spark):
    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (-1.0,), (2.0,), (float("nan"),), (None,)], "x double").select(geo.importance(F.col("x"))).collect()
    assert [r[0] for r in got] == [0, 32768, 65535, 0, 65535, 0, 0]


def asked(query):
    return [tuple(a) for a in house.asked_numbers(text.tokenize(query))]


def test_asked_numbers():
    assert asked("Osterstraße 42 A ") == [("42a", 2)] and asked("Rue de la Paix 12 bis") == [("12bis", 2)]
    assert asked("Anderter Straße 1-3") == [("1-3", 1)] and asked("Hauptstr 12/1") == [("12-1", 2)] and asked("5, 53111") == [("5", 0), ("53111", 0)]


CLASSES = [
    ("42A", "42a", 2, 0), ("42 a", "42a", 2, 0), ("42", "42a", 2, 2), ("1-3", "3", 0, 1), ("1-3", "2", 0, None), ("23 - 25", "24", 0, None), ("23 - 25", "25", 0, 1), ("40/42", "41", 0, None), ("12/1", "12-1", 2, 0), ("1-4", "2", 0, 1), ("1-500", "3", 0, None), ("12–14", "12-14", 2, 0), ("7", "8", 0, None)
]


def test_house_classes(spark):
    df = spark.createDataFrame(CLASSES, "w string, a string, d int, want int")
    for r in df.select("*", house.match_class(F.col("w"), F.col("a"), F.col("d")).alias("got")).collect():
        assert r.got == r.want == house.class_of(r.w, house.Asked(r.a, r.d)), r


def test_estimate():
    doors = [("15", 0, 0), ("16", 9000, 0), ("19", 3600, 0)]
    flat = lambda lat: 16
    assert house.estimate(doors, 17, flat) == (1800, 0) and house.estimate(doors, 15, flat) == (0, 0)
    assert house.estimate(doors, 18, flat) is None and house.estimate([("1", 0, 0), ("41", 10, 0)], 3, flat) is None and house.estimate([("1", 0, 0), ("5", 30000, 0)], 3, flat) is None


def test_estimates_reach_as_the_crow_flies():
    """Neighbours that are within reach on either axis but not together are too far apart; a house can be left out."""
    one = lambda lat: 16
    assert house.estimate([("1", 0, 0), ("3", 20_000, 20_000)], 2 + 1, one) == (20_000, 20_000)
    assert house.estimate([("1", 0, 0), ("5", 26_000, 26_000)], 3, one) is None
    assert house.estimate([("1", 0, 0), ("5", 18_000, -19_000)], 3, one) == (9_000, -9_500)
    assert house.estimate([("1", 0, 0), ("3", 7, 7), ("5", 400, 0)], 3, one, without=1) == (200, 0)


@pytest.mark.parametrize("given", ["жжpl", "жжжpl", "жжring", "жring", "abring", "abcring", "éstr", "ééstr", "aestr"])
def test_heads_count_bytes_on_both_sides(spark, given):
    (row,) = spark.createDataFrame([(given,)], "t string").select(text.distinct_words(F.col("t")).alias("w")).collect()
    assert list(row.w) == [t.word for t in text.tokenize(given)]


def test_bytes_are_capped_on_both_sides(spark):
    long = " ".join("w" * 60 + chr(97 + i) for i in range(26)) + " Straßenende"
    (row,) = spark.createDataFrame([(long,)], "t string").select(text.distinct_words(F.col("t")).alias("w"), text.dropped(F.col("t")).alias("n")).collect()
    assert list(row.w) == [t.word for t in text.tokenize(long)] and len(row.w) == 16 and row.n == 11
    assert spark.createDataFrame([("a b c",)], "t string").select(text.dropped(F.col("t")).alias("n")).first().n == 0


def test_numbers_that_were_read_match_as_written_ones(spark):
    numbers = ["1", "12a", "1-5", "2 - 8", "3/5", "5-1", "1-200", "7a-9b", "x", "", None, "1234567", "10–14", "2-5"]
    asked = [("1", 0), ("3", 0), ("12a", 2), ("12", 0), ("4", 0), ("12b", 2), ("7", 0), ("1-5", 1)]
    df = spark.createDataFrame([(n, a, d) for n in numbers for a, d in asked], "number string, asked string, digits int")
    one = house.class_between(F.col("normal"), F.col("low"), F.col("high"), F.col("asked"), F.col("digits"))
    rows = house.read(df).select("number", "asked", one.alias("got"), house.match_class(F.col("number"), F.col("asked"), F.col("digits")).alias("want"), F.col("v").alias("v"), house.leading(F.col("number")).alias("leading")).collect()
    assert all(r.got == r.want and r.v == r.leading for r in rows), [r for r in rows if r.got != r.want]
    assert {(r.number, r.asked): r.got for r in rows if r.got is not None}.items() >= {("1", "1"): 0, ("1-5", "3"): 1, ("2 - 8", "4"): 1, ("2-5", "3"): 1, ("10–14", "12"): 1, ("12a", "12a"): 0}.items()
