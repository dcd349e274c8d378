"""End to end: places, merged, indexed, searched."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import build, evaluate, search
from waymark.operators.index import GeoIndex, build_dump, build_index
from waymark.sources import dump

SCHEMA = (
    "dump_order long, entry_no int, kind int, name string, street string, city string, postcode string, house string, country string, importance int, has_point boolean, "
    "lat_e7 int, lon_e7 int, role int, variants array<struct<tag:string,name:string,city:string>>, texts array<string>, texts_dropped int"
)


def mini(spark, rows):
    """Rows of (name, city, postcode, lat, lon, kind, importance, houses[, more])."""
    out = []
    for name, city, postcode, lat, lon, kind, weight, houses, *more in rows:
        o = more[0] if more else {}
        point = o.get("point", True)
        place = dict(kind=kind, name=name, city=city, postcode=postcode, country=o.get("country"), importance=weight, has_point=point, lat_e7=lat if point else None, lon_e7=lon if point else None, role=o.get("role", 0), variants=o.get("variants", []))
        texts = [x for x in (name, city, postcode, *o.get("aliases", []), *(v["name"] for v in place["variants"] if v["name"])) if x]
        out.append(dict(dump_order=len(out), entry_no=0, street=None, house=None, texts=texts, texts_dropped=0, **place))
        for h in houses:
            number, hlat, hlon = h if isinstance(h, tuple) else (h, lat, lon)
            out.append(dict(dump_order=len(out), entry_no=0, kind=6, name=None, street=name, city=city, postcode=postcode, house=number, country=None, importance=0, has_point=True, lat_e7=hlat, lon_e7=hlon, role=0, variants=[], texts=[], texts_dropped=0))
    return spark.createDataFrame(out, SCHEMA)


SAMPLE = [
    ("Ahornallee", "Tannfeld", "40117", 512340000, 68010000, 5, 30000, ["3", "9", "14b"]),
    ("Kirchweg", "Neudorf", "10999", 525000000, 134000000, 5, 4000, ["21", "60"]),
    ("Kirchweg", "Altdorf", "14999", 523700000, 130100000, 5, 41000, ["21"]),
    ("Osada Nowa", "Krakau", "31-002", 500600000, 199400000, 9, 7000, []),
    ("Ringstraße", "Bergen", "29303", 528100000, 99600000, 5, 2500, ["5-11"]),
    ("Mühlgasse", "Seefeld", "82229", 480400000, 112100000, 5, 1800, [("25", 480400000, 112100000), ("29", 480404000, 112100000), ("26", 480410000, 112100000)]),
    ("Rom", "Rom", None, 418900000, 124900000, 4, 57000, [], {"variants": [{"tag": "en", "name": "Rome", "city": "Rome"}], "country": "IT"}),
    ("Dänemark", None, None, 560000000, 100000000, 1, 61000, [], {"country": "DK"}),
    ("Ringstraße", "Aarhus", "8000", 561500000, 102000000, 5, 8000, [], {"country": "DK"}),
    ("Sankt-Peter-Platz", "Bergen", "29303", 528200000, 99700000, 5, 900, []),
]
ASKED = [
    ("Ahornallee Tannfeld ", {}), ("Tannfeld Ahornallee ", {}), ("muehlgasse seefeld ", {}), ("muhlgasse seefeld ", {}), ("Ringstr. Bergen ", {}), ("Ahornallee xqzzy ", {}), ("xqzzy vwoop ", {}), ("Ahornallee Bergen ", {}), ("Kirchweg 10999 ", {}), ("Kirchweg 55555 ", {}),
    ("Ahornallee Tannfeld 9 ", {}), ("Ahornal", {}), ("Ahornal ", {"prefix": False}), ("Ahornal", {"prefix": True}), ("Ahornal Tannfeld ", {}), ("Kirch Altdorf ", {}), ("Kirchweg ", {"at": (52.5, 13.4)}), ("Kirchweg  ", {"at": (52.37, 13.01)}),
    ("Kirchweg   ", {"at": (-41.0, 174.0)}), ("Xqzzy Vwoop  ", {"at": (52.5, 13.4)}), ("Mühlgasse 27 ", {}), ("Mühlgasse 29 ", {}), ("Rom ", {"lang": "en"}), ("Ringstraße Dänemark ", {}), ("", {}), ("Ahornallee 40 ", {}), ("31-002 ", {}), ("Ringstraße 7 Bergen ", {}), ("Ahornallee 14c ", {}),
    ("Ah Tannfeld ", {}), ("St Peter Bergen ", {}), ("Ringstraße 8 Bergen ", {}),
]


def batch_of(spark, asked):
    rows = [(i, t, o.get("prefix", False), *(o.get("at") or (None, None)), o.get("lang"), 10) for i, (t, o) in enumerate(asked)]
    return spark.createDataFrame(rows, search._QUERY)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return build_index(mini(spark, SAMPLE), str(tmp_path_factory.mktemp("index")), ["de", "en"])


@pytest.fixture(scope="module")
def answers(spark, index):
    """All queries in one batch: text and whether the last word is a beginning, to answers."""
    got = index.search_df(batch_of(spark, ASKED)).orderBy("query_id", "rank").collect()
    return {(t, bool(o.get("prefix"))): [r for r in got if r.query_id == i] for i, (t, o) in enumerate(ASKED)}


def names(rows):
    return [(r.name, r.city) for r in rows]


def test_all_words_any_order(answers):
    assert names(answers["Ahornallee Tannfeld ", False]) == names(answers["Tannfeld Ahornallee ", False]) == [("Ahornallee", "Tannfeld")]
    assert names(answers["muehlgasse seefeld ", False]) == names(answers["muhlgasse seefeld ", False]) == [("Mühlgasse", "Seefeld")]
    assert names(answers["Ringstr. Bergen ", False]) == [("Ringstraße", "Bergen")]


def test_unknown_words(answers):
    assert names(answers["Ahornallee xqzzy ", False]) == [("Ahornallee", "Tannfeld")]
    assert not answers["xqzzy vwoop ", False] and not answers["Ahornallee Bergen ", False] and not answers["", False] and not answers["Xqzzy Vwoop  ", False]


def test_postcodes(answers):
    assert names(answers["Kirchweg 10999 ", False]) == [("Kirchweg", "Neudorf")]
    assert names(answers["Kirchweg 55555 ", False]) == [("Kirchweg", "Altdorf"), ("Kirchweg", "Neudorf")]
    assert names(answers["31-002 ", False]) == [("Osada Nowa", "Krakau")]


def test_house_numbers(answers):
    assert [(r.number, r.door) for r in answers["Ahornallee Tannfeld 9 ", False]] == [("9", 2)]
    assert [(r.number, r.door) for r in answers["Ringstraße 7 Bergen ", False]] == [("5-11", 2)]
    assert [r.number for r in answers["Ringstraße 8 Bergen ", False]] == [None]  # the range is of odd numbers
    assert [r.number for r in answers["Ahornallee 40 ", False]] == [None]


def test_prefixes(answers):
    assert not answers["Ahornal ", False] and names(answers["Ahornal", True]) == [("Ahornallee", "Tannfeld")]
    assert [(r.name, r.matched) for r in answers["Ahornal Tannfeld ", False]] == [("Ahornallee", 2)]
    assert names(answers["Kirch Altdorf ", False]) == [("Kirchweg", "Altdorf")]
    # A word that can't be looked up is let go of, and the name must begin with it.
    assert [(r.name, r.matched) for r in answers["Ah Tannfeld ", False]] == [("Ahornallee", 1)]
    assert names(answers["St Peter Bergen ", False]) == [("Sankt-Peter-Platz", "Bergen")]


def test_positions(answers):
    assert names(answers["Kirchweg ", False])[0] == ("Kirchweg", "Neudorf")
    assert names(answers["Kirchweg  ", False])[0] == ("Kirchweg", "Altdorf")
    assert len(answers["Kirchweg   ", False]) == 2


def test_estimates(answers):
    (r,) = answers["Mühlgasse 27 ", False]
    assert r.estimated and round(r.latitude * 1e7) == 480402000
    (r,) = answers["Mühlgasse 29 ", False]
    assert not r.estimated and r.number == "29"


def test_languages_and_countries(answers):
    assert names(answers["Rom ", False])[0] == ("Rome", "Rome")
    assert names(answers["Ringstraße Dänemark ", False]) == [("Ringstraße", "Aarhus")]


def plain_search(index, query, prefix_last, at, limit=10):
    """The documents of a query by trying each attempt on every document, ranked by the keys in plain Python; without a language or repeats."""
    docs = {r.doc_id: r for r in index.documents.collect()}
    vocabulary = {r.word for r in index.words.collect()}
    toks = [t._asdict() | {"seq": i, "known": t.word in vocabulary, "prefix_n": sum(w.startswith(t.word) for w in vocabulary)} for i, t in enumerate(text.tokenize(query))]
    cells = set()
    if at:
        lat, lon = (round(x * 1e7) for x in at)
        cells = {geo_token((lat + 900_000_000) // 1_000_000 + y, (lon + 1_800_000_000) // 1_000_000 + x) for y in (-1, 0, 1) for x in (-1, 0, 1)}

    def fits(d, a, ring=True):
        ok = all(any((t[1:] in d.words) if t[0] == "=" else any(w.startswith(t[1:]) for w in d.words) for t in g) for g in a["groups"])
        spoken = [*d.name_words, *d.city_words]
        return ok and (not (a["ring"] and ring) or bool(cells & set(d.words))) and all(any(t.startswith(w) for t in spoken for w in ws) for ws in a["checks"])

    for a in search.plan(toks, prefix_last, bool(at), index.countries()):
        if found := [d for d in docs.values() if fits(d, a)]:
            far = [d for d in docs.values() if a["ring"] and not fits(d, a) and fits(d, a, False) and d.importance >= 25_000]
            return a, found, far
    return None, [], []


def geo_token(row, column):
    n, out = row * 3600 + column % 3600, ""
    for _ in range(5):
        n, d = divmod(n, 36)
        out += "0123456789abcdefghijklmnopqrstuvwxyz"[d]
    return "@" + out


def test_search_against_a_plain_version(index, answers):
    """Each query's documents are those of the first attempt that finds any, in the order of the ranking's keys."""
    for t, o in ASKED:
        got = answers[t, bool(o.get("prefix"))]
        attempt, found, far = plain_search(index, t, o.get("prefix", False), o.get("at"))
        near = {d.doc_id for d in found}
        assert near <= {r.document for r in got} <= near | {d.doc_id for d in far}, t
        assert all(r.matched == len(attempt["groups"]) + attempt["ring"] for r in got)
        typed = {x.word for x in text.tokenize(t) if not x.part}
        named = {r.document: bool(o.get("at")) and any(x.word in typed for x in text.tokenize(next(d.name for d in [*found, *far] if d.doc_id == r.document) or "")) for r in got}
        keys = [(-r.agreement, -r.door, r.name is None, not named[r.document], r.band, -r.importance) for r in got]
        assert keys == sorted(keys), t


def test_stats(spark, index):
    got = {r.query_id: r for r in index.stats_df(batch_of(spark, [("Kirchweg 10999 ", {}), ("Kirchweg   ", {"at": (-41.0, 174.0)}), ("xqzzy ", {}), ("Ahornallee xqzzy ", {})])).collect()}
    assert (got[0].words, got[0].unknown, got[0].narrowed, got[0].groups, got[0].answered) == (2, 0, 1, 2, 0)
    assert got[1].position_dropped and got[1].narrowed == 2 and not got[0].position_dropped
    assert (got[2].attempts, got[2].answered, got[2].posting_lists) == (0, None, 0) and got[3].unknown == 1
    assert (got[1].posting_lists, got[1].posting_documents) == (1, 2)


def token(word, grp, joint="", known=True, prefix_n=1, part=False):
    return {"seq": grp, "word": word, "grp": grp, "part": part, "joint": joint, "known": known, "prefix_n": prefix_n}


def test_rounds():
    """The last round lets words go and reads none as a beginning; a word that stands for an abbreviation is let go of whatever it begins."""
    toks = [token("ga", 0, known=False, prefix_n=None), token("kirc", 1, known=False), token("altdorf", 2)]
    found = search.plan(toks, False, False, [])
    assert [a["groups"] for a in found] == [[["<kirc"], ["=altdorf"]], [["=altdorf"]], [["=altdorf"]]]
    assert [bool(a["checks"]) for a in found] == [False, False, True] and found[2]["checks"] == [["ga"]]
    found = search.plan([token("sankt", 0, prefix_n=3), token("altdorf", 1)], False, False, [])
    assert found[-1]["checks"] == [["sankt", "st"]] and found[-1]["groups"] == [["=altdorf"]]
    assert [a["beyond"] for a in search.plan([token("altdorf", 0)], False, True, [])] == [1, None]


def test_a_country_takes_a_groups_place():
    toks = [token("wort" + chr(97 + i), i) for i in range(20)] + [token("island", 20)]
    found = search.plan(toks, False, False, [("#is", [["island"]])])
    assert [len(a["groups"]) for a in found if a["narrowed"]] == [15] * sum(a["narrowed"] for a in found) and ["=#is"] in found[0]["groups"]
    assert {len(a["groups"]) for a in found if not a["narrowed"]} == {15}


def test_too_many_names_are_not_checked(spark, index, monkeypatch):
    assert index.search("Ah Tannfeld ")
    monkeypatch.setattr(search, "CHECKED", 0)
    assert [r["matched"] for r in index.search("Ah Tannfeld ")] == [1] and not index.search("Ah Bergenx ")
    assert search.matched(index, batch_of(spark, [("Ah Tannfeld ", {})])).fits.where("checked").isEmpty()


def test_api(spark, index):
    again = GeoIndex.open(spark, index.path)
    assert again.info()["documents"] == 10 and again.info()["houses"] == 10 and again.languages == ["de", "en"]
    (first,) = json.loads(again.search_json("Ahornallee 9 "))
    assert first["number"] == "9" and json.loads(again.search_json("xqzzy ")) == []
    assert '"latitude":51.2340000,' in again.search_json("Ahornallee 9 ")
    with pytest.raises(ValueError):
        again.search("x", language="xx")
    with pytest.raises(ValueError):
        again.search("x", position=(91, 0))
    doc = again.documents.where("name = 'Mühlgasse'").first().doc_id
    assert again.house_estimate(doc, 27) == (480402000, 112100000) and again.house_estimate(doc, 99) is None


LINES = [
    '{"type":"Place","content":[{"address_type":"street","country_code":"DE","postcode":"40117","importance":0.25,"name":{"name":"Ahornallee","name:en":"Maple Walk"},"address":{"city":"Tannfeld","other":["Ahornallee Nord"]},"centroid":[6.801,51.234]}]}',
    '{"type":"Place","content":[{"address_type":"locality","country_code":"PL","importance":0.1,"name":{"name":"Osada Nowa"},"address":{"city":"Kraków","city:de":"Krakau","city:fr":"Cracovie"},"centroid":[19.94,50.06]}]}',
    '{"type":"Place","content":[{"address_type":"house","housenumber":"21","name":{},"address":{"street":"Kirchweg","city":"Neudorf","postcode":"10999"},"centroid":[13.4,52.5]}]}',
    '{"type":"Place","content":[{"address_type":"city","importance":0.9,"name":{"name":"Roma","name:de":"Rom","name:en":"Rome"},"address":{},"centroid":[12.49,41.89]}]}',
    '{"type":"Place","content":[{"address_type":"other","name":{"name":"Alte Eiche"},"address":{"city":"Bergen"}}]}',
    '{"type":"Place","content":[{"address_type":"other","housenumber":"7","name":{"name":"Bootshaus"},"address":{"street":"Uferpfad","city":"Bergen"},"centroid":[9.9,52.8]}]}',
    '{"type":"Header","content":[{"address_type":"street","name":{"name":"x"}}]}',
    '{"type":"Place"}',
    "",
]


def test_dump(spark, tmp_path):
    path = tmp_path / "dump.jsonl"
    path.write_text("\n".join(LINES))
    rows = {r.dump_order: r for r in dump.places(dump.read_lines(spark, str(path)), ["de", "en"]).collect()}
    assert [(r.kind, r.name, r.street, r.city, r.postcode, r.house) for _, r in sorted(rows.items())] == [
        (5, "Ahornallee", "Ahornallee", "Tannfeld", "40117", None), (9, "Osada Nowa", None, "Krakau", None, None), (6, None, "Kirchweg", "Neudorf", "10999", "21"), (4, "Rom", None, "Rom", None, None), (7, "Bootshaus", "Uferpfad", "Bergen", None, "7")
    ]
    first = rows[0]
    assert (first.lat_e7, first.lon_e7, first.importance) == (512340000, 68010000, 16384)
    assert set(first.texts) == {"Tannfeld", "Ahornallee", "Maple Walk", "Ahornallee Nord", "40117"} and "Cracovie" not in rows[1].texts
    assert [tuple(v) for v in rows[3].variants] == [("en", "Rome", "Rome")]
    index = build_dump(spark, str(path), str(tmp_path / "index"), "de,en")
    assert index.info()["documents"] == 3 and index.manifest["houses"]["homeless"] == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"type":"Place","content":[{"address_type":"planet"}]}')
    with pytest.raises(Exception, match="unknown address_type"):
        dump.places(dump.read_lines(spark, str(bad)), ["de"]).collect()


def test_compressed_dump_and_its_stage(spark, tmp_path):
    """A zstd dump reads as the plain one; a second build takes the staged places while the dump is the same."""
    zstandard = pytest.importorskip("zstandard")
    path = tmp_path / "dump.jsonl.zst"
    path.write_bytes(zstandard.ZstdCompressor().compress("\n".join(LINES).encode()))
    cache = str(tmp_path / "cache")
    assert build_dump(spark, str(path), str(tmp_path / "i"), "de,en", cache=cache).info()["documents"] == 3
    before = spark.read.parquet(f"{cache}/places").inputFiles()
    assert build_dump(spark, str(path), str(tmp_path / "i"), "de,en", cache=cache).info()["documents"] == 3
    assert spark.read.parquet(f"{cache}/places").inputFiles() == before
    path.write_bytes(zstandard.ZstdCompressor().compress("\n".join(LINES[:1]).encode()))
    assert build_dump(spark, str(path), str(tmp_path / "i"), "de,en", cache=cache).info()["documents"] == 1
    assert build_dump(spark, str(path), str(tmp_path / "i"), "de", cache=cache).languages == ["de"]


def test_stage_is_read_only_while_current(spark, tmp_path):
    rows = mini(spark, SAMPLE[:1])
    assert dump.staged(spark, str(tmp_path / "s"), {"v": 1}) is None
    dump.stage(rows, str(tmp_path / "s"), {"v": 1})
    assert dump.staged(spark, str(tmp_path / "s"), {"v": 1}).count() == rows.count() and dump.staged(spark, str(tmp_path / "s"), {"v": 2}) is None


@pytest.mark.parametrize("text,want", [("de, EN de", ["de", "en"])])
def test_language_list(text, want):
    assert dump.languages(text) == want
    for bad in (" ", "all", "de,ALL"):
        with pytest.raises(ValueError):
            dump.languages(bad)


def town(name, lat, lon, kind, role, weight, postcode=None, city=None):
    return (name, city, postcode, lat, lon, kind, weight, [], {"role": role})


def merged(spark, rows):
    out = build.documents(build.records(mini(spark, rows)), lambda df: df.cache())
    return out.orderBy("doc_id").collect()


def test_boundary_joins_town(spark):
    (d,) = merged(spark, [town("Weil", 481000000, 92000000, 4, 1, 700), town("Weil", 480850000, 92100000, 3, 2, 9000)])
    assert (d.kind, d.importance, d.lat_e7) == (4, 9000, 481000000) and len(d.recs) == 2
    (d,) = merged(spark, [town("Horn", 476000000, 94000000, 9, 1, 3), town("Horn", 475900000, 94050000, 4, 2, 8)])
    assert d.kind == 4
    assert len(merged(spark, [town("Feld", 481000000, 92000000, 4, 1, 1), town("Feld", 481600000, 92000000, 3, 2, 1)])) == 2
    (d,) = merged(spark, [town("Date", 150000000, 1799980000, 4, 1, 1), town("Date", 150000000, -1799970000, 3, 2, 1)])
    assert d.lon_e7 == 1799980000


def test_segments_and_clusters(spark):
    s = lambda lat, postcode=None, weight=1, kind=5, **o: ("S", "T", postcode, lat, 0, kind, weight, [], o)
    (d,) = merged(spark, [s(0, weight=3), s(900000), s(300001)])
    assert (d.lat_e7, d.importance, len(d.recs)) == (400000, 3, 3)
    assert len(merged(spark, [s(0, "1"), s(900000, "2")])) == 2
    (d,) = merged(spark, [s(0, "1", 5), s(20000, None, 9)])
    assert (d.postcode, d.importance, d.lat_e7) == ("1", 9, 10000)
    assert len(merged(spark, [s(0, "1", kind=9), s(0, "2", kind=9, point=False)])) == 2
    assert len(merged(spark, [("", "T", None, 0, 0, 5, 1, []), (None, "T", None, 0, 0, 5, 1, []), (None, "T", None, 0, 0, 5, 1, [])])) == 3


def test_houses_find_streets(spark):
    keys = spark.createDataFrame([("S", "T", "1", 10), ("S", "T", "2", 11), ("R", "T", None, 12), ("Q", "U", "5", 13)], "name string, city string, postcode string, doc_id long")
    docs = spark.createDataFrame([(i, True, 0, 0) for i in (10, 11, 12, 13)], "doc_id long, has_point boolean, lat_e7 int, lon_e7 int")
    h = [(0, "S", "T", "2", 0, 0), (1, "R", "T", "9", 0, 0), (2, "S", "T", "9", 0, 0), (3, "Q", "X", "5", 199999, -150000), (4, "Q", "X", "5", 200001, 0), (5, "Z", "T", None, 0, 0), (6, "Q", "X", None, None, None)]
    got = build.house_to_street(spark.createDataFrame(h, "house_id int, street string, city string, postcode string, lat_e7 int, lon_e7 int"), keys, docs).orderBy("house_id").collect()
    assert [(r.doc_id, r.relaxed) for r in got] == [(11, 0), (12, 1), (10, 2), (13, 3), (None, None), (None, None), (None, None)]


def test_boundaries_in_order(spark):
    """The first boundary of a city's kind gives its town the kind; one that stands before the town lends its postcode to those behind it."""
    at = lambda rows: {(r.role0, r.dump_order): r for r in build.land_to_town(build.records(mini(spark, rows)).withColumn("role0", F.col("role"))).collect()}
    town_ = lambda kind, role, city, postcode, lat=0: ("Au", city, postcode, 470000000 + lat, 90000000, kind, 1, [], {"role": role})
    got = at([town_(9, 1, "Au", None), town_(3, 2, "Zz", "1"), town_(11, 2, "Zz", "2"), town_(10, 2, "Zz", "7", 300)])
    assert {k: r.kind for k, r in got.items()} == {(1, 0): 11, (2, 1): 9, (2, 2): 11, (2, 3): 11}
    assert all(r.city == "Au" and r.role == 1 and r.lat_e7 == 470000000 for r in got.values()) and got[2, 3].postcode == "7"
    got = at([town_(4, 1, "M", None), town_(3, 2, "A", "1"), town_(3, 2, "Z", None), town_(3, 2, "Z", "9")])
    assert [got[2, i].postcode for i in (1, 2, 3)] == ["1", "1", "1"] and got[1, 0].postcode is None


def test_left_out_estimates(spark):
    from waymark.operators import estimate

    houses = spark.createDataFrame([(1, "1", 0, 0), (1, "5", 4000, 0), (1, "9", 8000, 0), (1, "2", 0, 50), (1, "4", 30000, 30000), (2, "7", 0, 0), (2, "7", 100, 0), (3, "x", 0, 0), (1, "40", 9, 9)], "doc_id long, number string, lat_e7 int, lon_e7 int")
    got = {(r.doc_id, r.number, r.lat_e7 if "lat_e7" in r else None): r for r in estimate.left_out(houses).collect()}
    five = next(r for (d, n, _), r in got.items() if (d, n) == (1, "5"))
    assert five.estimated and five.metres < 0.01 and not next(r for (d, n, _), r in got.items() if (d, n) == (1, "9")).estimated
    found = {(r.doc_id, r.number): (r.lat_e7, r.lon_e7) for r in estimate.estimates(houses, spark.createDataFrame([(1, 3), (1, 7), (2, 7), (2, 9), (1, 0)], "doc_id long, number int")).collect()}
    assert found == {(1, 3): (2000, 0), (1, 7): (6000, 0), (2, 7): (0, 0)}


def test_dense_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = build.numbered(df, [F.col("x").asc()], "n", lambda d: d.cache()).collect()
    assert all(r.n == r.x for r in got)


def test_evaluation(spark, index, tmp_path):
    lines = ["category\tquery\tprefix\tlimit\texpect_name\texpect_city\texpect_number", "# comment", "street.a\tAhornallee Tannfeld \t0\t1\tAhornallee\tTannfeld|Firfield\t", "street.b\tKirchweg \t0\t1\tKirchweg\tNeudorf\t", "house\tAhornallee 9 \t0\t1\tAhorn-Allee|Ahornallee\t\t9", "absent\tHinterland 1 \t0\t1\tHinterland\tNix\t"]
    path = tmp_path / "q.tsv"
    path.write_text("\n".join(lines) + "\n")
    ranked, report, missed = evaluate.evaluate(index, evaluate.read_queries(spark, str(path)))
    assert {r.category: (r.rank, r.absent) for r in ranked.collect()} == {"street.a": (1, False), "street.b": (2, False), "house": (1, False), "absent": (0, True)}
    total = report.where("level = 'all'").first()
    assert (total.n, total.absent, total.passed, total.top1, total.top3) == (4, 1, 2, 2, 3)
    shown = {r.category: r for r in missed.collect()}
    assert set(shown) == {"street.b", "absent"} and shown["absent"].absent and shown["street.b"].expected == "name Kirchweg town Neudorf"
    assert shown["street.b"].answers[0] == "1. Kirchweg, 14999 Altdorf (kind 5)" and shown["absent"].answers == []


@pytest.mark.parametrize("line", ["street\tx\t2\t1\tn\t\t", "street\t\t0\t1\tn\t\t", "\tx\t0\t1\tn\t\t", "street\tx\t0\t0\tn\t\t", "street\tx\t0\t1\t\t\t", "street\tx\t0\t1\tn\t1.0\t", "street\tx\t0\tnan\tn\t\t"])
def test_query_files_are_read_strictly(spark, tmp_path, line):
    path = tmp_path / "q.tsv"
    path.write_text("category\tquery\tprefix\tlimit\texpect_name\tlat\tlon\n" + line + "\n")
    with pytest.raises(Exception, match="can't be read"):
        evaluate.read_queries(spark, str(path)).collect()
    path.write_text("category\tprefix\nx\t1\n")
    with pytest.raises(ValueError):
        evaluate.read_queries(spark, str(path))


def test_doors_and_lines(spark):
    df = spark.createDataFrame([("Kirchweg", "21", "Kirchweg 21|x", True), ("Kirchweg", "21", "Kirchweg 22", False), ("Kirchweg", None, "Kirchweg", False)], "n string, h string, w string, want boolean")
    assert all(r.got == r.want for r in df.select(evaluate.door(F.col("n"), F.col("h"), F.col("w")).alias("got"), "want").collect())
    lines = spark.createDataFrame([(x, i) for i, x in enumerate([*(x for x in LINES if x), "{broken"])], "line string, dump_order long")
    assert dump.line_census(lines).first().asDict() == {"lines": 9, "invalid": 2, "other": 1, "entries": 6}
    rows = dump.places(lines.where("line <> '{broken' and line <> '{\"type\":\"Place\"}'"), ["de"])
    assert json.loads(dump.as_json(rows).first()["json"])["name"] == "Ahornallee"
