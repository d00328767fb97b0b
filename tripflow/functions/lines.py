"""Line geometry: encoded polylines and GeoJSON lines from arrays of points.

A line is an ``array<struct<lat double, lon double>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the encoded polyline format.
FIXED_POINT_SCALE = 1e5
CHUNK_BITS = 5
CHUNK_MASK = 0x1F
CONTINUATION_BIT = 0x20
CHAR_OFFSET = 63
# The chunks that any number of 64 bits can need.
NUMBER_CHUNKS = -(-64 // CHUNK_BITS)


def fixed_point(degrees: Column) -> Column:
    """Nearest fixed-point integer, halves to even."""
    return F.rint(degrees * FIXED_POINT_SCALE).cast("long")


def zigzag(step: Column) -> Column:
    """Signed step to a non-negative number, small for small steps of either sign."""
    return F.when(step < 0, -2 * step - 1).otherwise(2 * step)


def chunk_text(number: Column) -> Column:
    """Low chunks first, the last without continuation bit."""
    texts = []
    for i in range(NUMBER_CHUNKS):
        rest = F.shiftright(number, CHUNK_BITS * i) if i else number
        more = F.when(rest > CHUNK_MASK, CONTINUATION_BIT + CHAR_OFFSET).otherwise(CHAR_OFFSET)
        text = F.char(rest.bitwiseAND(CHUNK_MASK) + more)
        # every chunk after the highest set one is absent
        texts.append(text if i == 0 else F.when(rest > 0, text).otherwise(""))
    return F.concat(*texts)


def encode_polyline(line: Column) -> Column:
    """Encoded polyline of an ordered line; null for a null or empty line."""
    grid = F.transform(
        line, lambda p: F.struct(fixed_point(p["lat"]).alias("lat"), fixed_point(p["lon"]).alias("lon"))
    )
    origin = F.array(F.struct(F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lon")))
    before = F.slice(F.concat(origin, grid), 1, F.size(line))
    steps = F.zip_with(
        grid,
        before,
        lambda p, q: F.struct(zigzag(p["lat"] - q["lat"]).alias("lat"), zigzag(p["lon"] - q["lon"]).alias("lon")),
    )
    texts = F.transform(steps, lambda s: F.concat(chunk_text(s["lat"]), chunk_text(s["lon"])))
    return F.when(F.size(line) > 0, F.array_join(texts, ""))


def lon_lat_pairs(line: Column) -> Column:
    """GeoJSON axis order, an empty array for a missing line."""
    pairs = F.transform(line, lambda p: F.array(p["lon"], p["lat"]))
    return F.coalesce(pairs, F.array().cast("array<array<double>>"))


def geojson_line(line: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), lon_lat_pairs(line).alias("coordinates"))


def from_lon_lat(pairs: Column) -> Column:
    """``[[lon, lat], ...]`` to a line."""
    return F.transform(pairs, lambda c: F.struct(c[1].alias("lat"), c[0].alias("lon")))
