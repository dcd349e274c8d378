"""House numbers: as written, as asked for, ranges, and positions estimated between neighbours."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.text import Token

# Longest number asked for, widest written range, widest gap between neighbours by number and in e7, suffixes that are words.
LONGEST, WIDEST, GAP, SPAN = 32, 100, 20, 27_000
SUFFIX = r"^([a-z]|bis|ter|quater)$"
AS_ASKED, IN_RANGE, PLAIN = 0, 1, 2
_RANGE = "^([0-9]{1,6})[a-z]?-([0-9]{1,6})[a-z]?$"


def normal(written: Column) -> Column:
    """Blanks dropped, lowered, slashes and dashes as `-`."""
    return F.translate(F.lower(F.replace(written, F.lit(" "), F.lit(""))), "/‐‑‒–—", "------")


def leading(written: Column) -> Column:
    """The digits a number begins with, if they are six at most."""
    return F.regexp_extract(normal(written), "^([0-9]{1,6})(?![0-9])", 1).try_cast("int")


def _ends(written: Column) -> tuple[Column, Column]:
    return tuple(F.when(~F.contains(written, F.lit("/")), F.regexp_extract(normal(written), _RANGE, i)).try_cast("int") for i in (1, 2))


def range_holds(written: Column, value: Column) -> Column:
    """Whether a written range such as 1-5 holds a value: of one parity, if its ends are of one."""
    a, b = _ends(written)
    inside = (a < b) & (b - a <= WIDEST) & value.between(a, b)
    return F.coalesce(inside & ((a % 2 != b % 2) | (value % 2 == a % 2)), F.lit(False))


def read(houses: DataFrame) -> DataFrame:
    """houses with their number as it is matched: normal, v (its leading value), and low and high of a written range. Step by step, so that each is computed once."""
    out = houses.withColumn("normal", normal(F.col("number")))
    ranged = F.contains("normal", F.lit("-")) & ~F.contains("number", F.lit("/"))
    ends = F.split(F.when(ranged & F.col("normal").rlike(_RANGE), F.regexp_replace("normal", "[a-z]", "")), "-")
    out = out.withColumns({"v": F.regexp_extract("normal", "^([0-9]{1,6})(?![0-9])", 1).try_cast("int"), "_ends": ends})
    out = out.withColumns({"low": F.col("_ends")[0].cast("int"), "high": F.col("_ends")[1].cast("int")}).drop("_ends")
    wide = (F.col("low") < F.col("high")) & (F.col("high") - F.col("low") <= WIDEST)
    return out.withColumn("low", F.when(wide, F.col("low"))).withColumn("high", F.when(F.col("low").isNotNull(), F.col("high")))


def holds(low: Column, high: Column, value: Column) -> Column:
    """Whether a range as `read` gives it holds a value."""
    return F.coalesce(value.between(low, high) & ((low % 2 != high % 2) | (value % 2 == low % 2)), F.lit(False))


def match_class(written: Column, asked: Column, digits: Column) -> Column:
    """How a written number answers one asked for: AS_ASKED, IN_RANGE, PLAIN (its digits only), or null."""
    a, b = _ends(written)
    wide = (a < b) & (b - a <= WIDEST)
    return class_between(normal(written), F.when(wide, a), F.when(wide, b), asked, digits)


def class_between(own: Column, low: Column, high: Column, asked: Column, digits: Column) -> Column:
    """The same of a number that was read: normal, and low and high of its range or null."""
    value = F.when(asked.rlike("^[0-9]{1,6}$"), asked).try_cast("int")
    plain = F.coalesce(digits > 0, F.lit(False)) & (own == F.substring(asked, F.lit(1), digits))
    return F.when(own == asked, AS_ASKED).when(holds(low, high, value), IN_RANGE).when(plain, PLAIN)


class Asked(NamedTuple):
    text: str
    digits: int  # of the plain number something follows, else 0


def asked_numbers(tokens: list[Token]) -> list[Asked]:
    """The house numbers a query asks for, with a suffix or second number that belongs to them."""
    whole = [t for t in tokens if not t.part]
    digit = [any(c in "0123456789" for c in t.word) for t in whole]

    def suffix(i):
        return i > 0 and digit[i - 1] and not digit[i] and re.match(SUFFIX, whole[i].word) and whole[i].joint in ("", "-") and whole[i].grp == whole[i - 1].grp + 1

    def second(i):
        return i > 0 and digit[i - 1] and digit[i] and whole[i].joint in ("-", "/") and whole[i].grp == whole[i - 1].grp + 1

    out = []
    for i, t in enumerate(whole):
        if not digit[i] or second(i):
            continue
        text = t.word
        if i + 1 < len(whole) and suffix(i + 1):
            text += whole[i + 1].word
        elif i + 1 < len(whole) and second(i + 1):
            text += "-" + whole[i + 1].word
        plain = len(re.match(r"[0-9]*", text)[0])
        if len(text.encode()) <= LONGEST:
            out.append(Asked(text, plain if 0 < plain < len(text) else 0))
    return out


# The same on the driver.


def normal_of(written: str) -> str:
    return re.sub("[/‐‑‒–—]", "-", "".join(c.lower() if c.isascii() else c for c in written if c != " "))


def leading_of(written: str) -> int | None:
    m = re.match(r"([0-9]{1,6})(?![0-9])", written.replace(" ", ""))
    return int(m[1]) if m else None


def holds_of(written: str, value: int) -> bool:
    m = None if "/" in written else re.fullmatch(r"([0-9]{1,6})[a-z]?-([0-9]{1,6})[a-z]?", normal_of(written))
    if not m:
        return False
    a, b = int(m[1]), int(m[2])
    return a < b and b - a <= WIDEST and a <= value <= b and (a % 2 != b % 2 or value % 2 == a % 2)


def class_of(written: str, asked: Asked) -> int | None:
    if normal_of(written) == asked.text:
        return AS_ASKED
    if re.fullmatch("[0-9]{1,6}", asked.text) and holds_of(written, int(asked.text)):
        return IN_RANGE
    return PLAIN if asked.digits and normal_of(written) == asked.text[: asked.digits] else None


def find(houses: list[tuple], asked: list[Asked]):
    """The first of the houses (number, lat, lon; in order) that answers, by class, then by number asked: (house, class, asked)."""
    for kind in (AS_ASKED, IN_RANGE, PLAIN):
        for a in asked:
            for h in houses:
                if (class_of(h[0], a) == kind) if kind != PLAIN else (a.digits and normal_of(h[0]) == a.text[: a.digits]):
                    return h, kind, a
    return None


def estimate(houses: list[tuple], number: int, shrink_of, without: int | None = None) -> tuple[int, int] | None:
    """A position for a number on the line between its nearest neighbours of its parity; without: the house that is left out, by its place in the list."""
    side = [(v, lat, lon) for i, (n, lat, lon) in enumerate(houses) if i != without and lat is not None and (v := leading_of(n)) is not None and (v - number) % 2 == 0]
    below = max((h for h in side if h[0] <= number), key=lambda h: h[0], default=None)
    above = min((h for h in side if h[0] >= number), key=lambda h: h[0], default=None)
    if not below or not above or above[0] - below[0] > GAP or not number:
        return None
    (low, lat, lon), (high, lat2, lon2) = below, above
    flat = truncated((lon2 - lon) * shrink_of(lat), 16)
    if (lat2 - lat) ** 2 + flat**2 > SPAN**2:
        return None
    share = lambda whole: truncated(whole * (number - low), high - low) if high > low else 0
    return lat + share(lat2 - lat), lon + share(lon2 - lon)


def truncated(a: int, b: int) -> int:
    return abs(a) // b * (1 if a >= 0 else -1)


def between(below: Column, above: Column, number: Column) -> Column:
    """The same of two structs (v, lat_e7, lon_e7): lat_e7 and lon_e7, or null."""
    div = lambda a, b: F.call_function("div", a, b)
    north, east = (above[c].cast("long") - below[c] for c in ("lat_e7", "lon_e7"))
    flat = div(east * geo.shrink(below["lat_e7"]), F.lit(16))
    steps = F.greatest(above["v"] - below["v"], F.lit(1))
    ok = (above["v"] - below["v"] <= GAP) & (north * north + flat * flat <= SPAN * SPAN)
    along = lambda c, whole: (below[c] + div(whole * (number - below["v"]), steps)).cast("int")
    return F.when(ok, F.struct(along("lat_e7", north).alias("lat_e7"), along("lon_e7", east).alias("lon_e7")))
