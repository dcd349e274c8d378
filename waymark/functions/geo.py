"""Coordinates in 1e-7 degrees (e7), a grid of 0.1 degrees, and distances in integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells across and around, e7 of a cell, sixteenths that a degree of longitude shrinks to by 10 degrees of latitude, bands of squared distance.
ROWS, COLUMNS, CELL = 1800, 3600, 1_000_000
SHRINK = (16, 16, 15, 14, 12, 10, 8, 5, 3, 1)
BANDS = (180_000, 900_000, 4_500_000)
TURN = 3_600_000_000
FAR = (1 << 63) - 1


def e7(degrees: Column) -> Column:
    return F.round(degrees * 10_000_000.0).cast("int")


def row_of(lat: Column) -> Column:
    return F.least(F.greatest(F.floor((lat.cast("long") + 900_000_000) / CELL), F.lit(0)), F.lit(ROWS - 1)).cast("int")


def column_of(lon: Column) -> Column:
    return F.pmod(F.floor((lon.cast("long") + 1_800_000_000) / CELL), F.lit(COLUMNS)).cast("int")


def cell(lat: Column, lon: Column) -> Column:
    return row_of(lat) * COLUMNS + column_of(lon)


def cell_token(number: Column) -> Column:
    """`@` and five digits to base 36, the least first."""
    return F.concat(F.lit("@"), F.reverse(F.lpad(F.lower(F.conv(number.cast("string"), 10, 36)), 5, "0")))


def country_token(code: Column) -> Column:
    return F.when(code.rlike("^[A-Za-z]{2}$"), F.concat(F.lit("#"), F.lower(code)))


def ring(lat: Column, lon: Column, radius: int = 1) -> Column:
    """Cells around a point: rows end at the poles, columns wrap."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    r, c = row_of(lat), column_of(lon)
    rows = F.filter(F.transform(steps, lambda d: r + d), lambda x: (x >= 0) & (x < ROWS))
    return F.array_distinct(F.flatten(F.transform(rows, lambda x: F.transform(steps, lambda d: x * COLUMNS + F.pmod(c + d, F.lit(COLUMNS))))))


def shrink(lat: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SHRINK)), (F.least(F.floor(F.abs(lat.cast("long")) / 100_000_000), F.lit(9)) + 1).cast("int"))


def _div(a: Column, b: int) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a, F.lit(b))


def distance2(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in e7; longitudes wrap and shrink with the first point's latitude; FAR where a point is missing."""
    east = (lon2.cast("long") - lon.cast("long")) % TURN
    east = F.when(east > TURN // 2, east - TURN).when(east < -(TURN // 2), east + TURN).otherwise(east)
    east = _div(east * shrink(lat), 16)
    north = lat2.cast("long") - lat.cast("long")
    return F.coalesce(east * east + north * north, F.lit(FAR))


def band(d2: Column) -> Column:
    out = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        out = F.when(d2 <= BANDS[i] ** 2, i).otherwise(out)
    return out


def metres(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance in metres between e7 points, 111195 m a degree, longitudes shrunk at the mean latitude."""
    north = (lat2 - lat) / 1e7
    east = F.abs(lon2.cast("long") - lon.cast("long"))
    east = F.least(east, TURN - east) / 1e7 * F.cos(F.radians((lat.cast("double") + lat2) / 2e7))
    return F.sqrt(north * north + east * east) * 111195.0


def importance(x: Column) -> Column:
    """A weight of 0 to 1 in 65536 steps."""
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), 0).when(x >= 1, 65535).otherwise(F.floor(x * 65535 + 0.5)).cast("int")


# The same on the driver.


def distance2_of(lat, lon, lat2, lon2) -> int:
    if None in (lat, lon, lat2, lon2):
        return FAR
    east = lon2 - lon
    east = east - TURN if east > TURN // 2 else east + TURN if east < -(TURN // 2) else east
    east = east * SHRINK[min(abs(lat) // 100_000_000, 9)]
    east = east // 16 if east >= 0 else -(-east // 16)
    return east * east + (lat2 - lat) ** 2


def band_of(d2: int) -> int:
    return next((i for i, b in enumerate(BANDS) if d2 <= b * b), len(BANDS))
