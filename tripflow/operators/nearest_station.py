"""k nearest stations per point within a radius, without pairing points and stations.

The stations become a tree once: neighbours on a space-filling curve are packed
into groups of eight, groups into groups, up to a few at the top. A group knows
its centre, its radius, how many stations it holds, and its children. A point
opens groups from the top: a group at distance d with radius r has all its
stations between d - r and d + r, so with the counts the groups tell within
which distance k stations lie, and what is further away stays closed. Nothing is
cut short, so the result is exact. How tight the stations stand or from how far
they are seen does not matter: a point opens some groups of a level, not a list.

Points are searched in Arrow batches: those that lie together close groups
together, and are halved until the pairs of points and entries left are few.
They are never exploded over stations, grouped or sorted. Up to a measured size
the entries at the bottom of the tree are handed to every task. A tree above it
is cut: its upper part names the subtrees that a point still needs, and chunks
of points are joined with those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripflow.functions.geo import EARTH_RADIUS_MILES
from tripflow.session import cut_lineage
from tripflow.sources.logs import read_record, write_record

# Neighbours per trip, their reach, the softening of the weight.
NEIGHBOURS = 10
MAX_MILES = 25.0
WEIGHT_SOFTENING = 1e-3

FAN_BITS = 3  # a group holds up to eight
CURVE_BITS = 24  # cells of the curve are about five feet wide
SLACK_MILES = 1e-6
SLACK_CHORD = SLACK_MILES / EARTH_RADIUS_MILES
# Points are halved until they make no more pairs with entries than this, or are this few; never above the most.
LEAF_PAIRS, LEAF_POINTS, MOST_PAIRS = 1 << 13, 4, 1 << 18
CHUNK_BITS = 13  # points that meet a subtree together: up to 8,192
# Distances closer than this count as equal and are ordered by station id, so
# that rounding noise in trigonometric functions cannot decide a rank.
TIE_SCALE = 1e8


@dataclass(frozen=True)
class StationIndex:
    tree: DataFrame  # one row, top: the uppermost groups
    levels: int  # how often groups of ``tree`` are opened until stations, or ids of subtrees, are reached
    subtrees: DataFrame | None  # id, top: the groups below the cut
    sub_levels: int
    k: int
    max_miles: float


def _interleaved(x: Column, y: Column) -> Column:
    """The bits of two whole numbers in turn: position on the curve."""

    def spread(v: Column) -> Column:
        v = v.bitwiseAND(F.lit((1 << CURVE_BITS) - 1))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def _one_position_at_most(stations: DataFrame, k: int) -> DataFrame:
    """Of stations at the very same place only the first k by id can rank among k."""
    place = W.partitionBy("station.lat", "station.lon").orderBy("station")
    return stations.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).drop("rank")


def _miles(phi: Column, theta: Column, cos: Column, to) -> Column:
    """Great-circle miles between a place in radians and a struct (phi, theta, cos)."""
    half_lat, half_lon = F.sin((to["phi"] - phi) * 0.5), F.sin((to["theta"] - theta) * 0.5)
    chord = F.pow(half_lat, 2) + cos * to["cos"] * F.pow(half_lon, 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), chord))) * (2 * EARTH_RADIUS_MILES)


def _placed(stations: DataFrame, fields: list[str], k: int) -> DataFrame:
    """(code, phi, theta, cos, radius, n, content): stations numbered along the curve."""
    rows = stations.dropna(subset=["lat", "lon"]).select(F.struct(*fields).alias("station"))
    lat, lon = F.col("station.lat"), F.col("station.lon")
    cells = float(1 << CURVE_BITS)
    x, y = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * cells), F.floor(F.least((lat + 90.0) / 180.0 * cells, F.lit(cells - 1)))
    spot = _one_position_at_most(rows, k).withColumn("z", _interleaved(x, y))
    ordered = spot.repartitionByRange("z", "station").sortWithinPartitions("z", "station")
    # the number of the partition above, the place in it below: the order along the curve
    return cut_lineage(
        ordered.select(
            F.monotonically_increasing_id().alias("at"), F.radians(lat).alias("phi"), F.radians(lon).alias("theta"),
            F.cos(F.radians(lat)).alias("cos"), F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("n"), F.col("station").alias("content"),
        )
    )


def _grouped(level: DataFrame) -> DataFrame:
    """The groups of up to eight neighbours each, with centre, radius and count."""
    members = F.sort_array(F.collect_list(F.struct("code", "phi", "theta", "cos", "radius", "n", "content")))
    packed = level.groupBy(F.shiftright("code", FAN_BITS).alias("code")).agg(members.alias("m"))

    def total(value) -> Column:
        return F.aggregate(F.transform("m", value), F.lit(0.0), lambda s, x: s + x)

    # the mean of the directions, found in space: right at the poles and the date line
    packed = packed.withColumns(
        {
            "x": total(lambda e: e["cos"] * F.cos(e["theta"])),
            "y": total(lambda e: e["cos"] * F.sin(e["theta"])),
            "z": total(lambda e: F.sin(e["phi"])),
        }
    )
    packed = packed.withColumns({"phi": F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), "theta": F.atan2("y", "x")})
    packed = packed.withColumn("cos", F.cos("phi"))
    reach = F.array_max(F.transform("m", lambda e: _miles(F.col("phi"), F.col("theta"), F.col("cos"), e) + e["radius"]))
    count = F.aggregate("m", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    content = F.transform("m", lambda e: F.struct(*[e[c].alias(c) for c in ("phi", "theta", "cos", "radius", "n", "content")]))
    return packed.select("code", "phi", "theta", "cos", (reach + SLACK_MILES).alias("radius"), count.alias("n"), content.alias("content"))


def build_station_index(
    stations: DataFrame,
    payload: list[str],
    k: int = NEIGHBOURS,
    max_miles: float = MAX_MILES,
    tree_bytes: int = 1 << 20,
) -> StationIndex:
    """Index over ``station_id``, ``lat``, ``lon`` and the ``payload`` columns.

    One sort of the stations and one small aggregation a level. ``tree_bytes``
    bounds what every task is handed; above it the tree is cut so that the upper
    part fits. A subtree is a row of 8 to the power of its levels stations at most.
    """
    level = _placed(stations, ["station_id", "lat", "lon", *payload], k)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    n, parts, most = level.agg(F.count("*"), F.max(part), F.max(place)).first()
    bits = FAN_BITS * math.ceil((most or 0).bit_length() / FAN_BITS)
    level = level.withColumn("code", F.shiftleft(part, bits).bitwiseOR(place)).drop("at")
    # each level takes its bits off the numbers; the last ones that are left number the uppermost groups
    depth = max(1, math.ceil((bits + (parts or 0).bit_length()) / FAN_BITS)) - 1
    size = n * (100 + 16 * len(payload))
    subtrees, below = None, 0
    if size > tree_bytes and depth:
        while below == 0 or (below < depth and size >> FAN_BITS * below > tree_bytes):
            level, below = _grouped(level), below + 1
        level = cut_lineage(level)
        subtrees = cut_lineage(level.select(F.col("code").alias("id"), F.col("content").alias("top")))
        level = level.withColumn("content", F.col("code"))
    for _ in range(depth - below):
        level = _grouped(level)
    entry = F.struct("phi", "theta", "cos", "radius", "n", "content")
    tree = cut_lineage(level.agg(F.collect_list(entry).alias("top")))
    return StationIndex(tree, depth - below, subtrees, max(0, below - 1), k, max_miles)


def save_station_index(index: StationIndex, path: str) -> None:
    """The index as tables below ``path``, to be used by later jobs."""
    spark = index.tree.sparkSession
    index.tree.write.mode("overwrite").parquet(f"{path}/tree")
    if index.subtrees is not None:
        index.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
    record = {f: getattr(index, f) for f in ("levels", "sub_levels", "k", "max_miles")} | {"cut": index.subtrees is not None}
    write_record(spark, record, f"{path}/record")


def load_station_index(spark: SparkSession, path: str) -> StationIndex:
    record = read_record(spark, f"{path}/record")
    subtrees = spark.read.parquet(f"{path}/subtrees") if record.pop("cut") else None
    return StationIndex(tree=spark.read.parquet(f"{path}/tree"), subtrees=subtrees, **record)


def _measured(points: DataFrame) -> DataFrame:
    """Adds ``_d``, the distances of the entries ``_e``."""
    angles = [F.col(c) for c in ("_phi", "_theta", "_cos")]
    return points.withColumn("_d", F.transform("_e", lambda e: _miles(*angles, e)))


def _kept(points: DataFrame, k: int, max_miles: float) -> DataFrame:
    """``_e`` without the entries that cannot hold one of the k nearest.

    In the order of their furthest point, the entry that makes k stations full
    bounds the distance of the k-th.
    """
    ends = F.transform("_e", lambda e, i: F.struct((F.col("_d")[i] + e["radius"]).alias("end"), e["n"].alias("n")))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("end"))
    filled = F.aggregate(
        F.sort_array(ends), none, lambda s, e: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + e["n"]).alias("n"), e["end"].alias("end")))
    )
    bounded = _measured(points).withColumn("_full", filled)
    bound = F.least(F.when(F.col("_full.n") >= k, F.col("_full.end")).otherwise(F.lit(max_miles)), F.lit(max_miles))
    bounded = bounded.withColumn("_bound", bound + SLACK_MILES)
    return bounded.withColumn("_e", F.filter("_e", lambda e, i: F.col("_d")[i] - e["radius"] <= F.col("_bound")))


def _descended(points: DataFrame, levels: int, k: int, max_miles: float) -> DataFrame:
    """``_e`` opened ``levels`` times, as column expressions: what one point opens, level by level."""
    for _ in range(levels):
        points = _kept(points, k, max_miles).withColumn("_e", F.flatten(F.col("_e.content")))
    return points


def nearest_stations(points: DataFrame, index: StationIndex, lat: Column, lon: Column) -> DataFrame:
    """``points`` plus ``neighbours``: up to k structs, nearest first; empty if none.

    One row generated per point keeps later filters on ``neighbours`` from being
    pushed into the search, which would repeat it.
    """
    if index.subtrees is not None:
        return _nearest_in_subtrees(points, index, lat, lon)
    bottom = _opened(index.tree, index.levels).select(F.inline("top")).orderBy("content").toArrow()
    search = _neighbour_search(bottom, _neighbour_type(index.tree, index.levels), index)
    found = points.withColumn("_found", search(lat.cast("double"), lon.cast("double")))
    return found.select(*points.columns, F.inline(F.array(F.struct(F.col("_found").alias("neighbours")))))


def _nearest_in_subtrees(points: DataFrame, index: StationIndex, lat: Column, lon: Column) -> DataFrame:
    """The same where the tree is cut: points meet the few subtrees that they need, and their finds are merged.

    The points are written once with a number each, so that no task that runs
    again deals other numbers. Those of some thousand numbers in a row that need
    a subtree meet it together, so a subtree is handed on once for all of them
    and one that many points need is dealt over many rows.
    """
    own = cut_lineage(points.select(F.monotonically_increasing_id().alias("_row"), F.struct(*points.columns).alias("_point"), lat.cast("double").alias("_lat"), lon.cast("double").alias("_lon")))
    upper = _opened(index.tree, index.levels).select(F.inline("top")).toArrow()
    wanted = own.select("_row", "_lat", "_lon", F.explode(_subtree_search(upper, index)("_lat", "_lon")).alias("id"))
    chunks = wanted.groupBy("id", F.shiftright("_row", CHUNK_BITS).alias("_chunk")).agg(F.collect_list(F.struct("_row", "_lat", "_lon")).alias("_points"))
    held = _opened(index.subtrees, index.sub_levels).select("id", F.array_sort("top", _by_content).alias("top"))
    kind = _neighbour_type(index.subtrees, index.sub_levels)
    rows = T.StructType([T.StructField("_row", T.LongType()), T.StructField("neighbours", kind)])
    found = chunks.join(held, "id").select("_points", "top").mapInArrow(_chunk_search(index), rows)
    finds = found.groupBy("_row").agg(F.flatten(F.collect_list("neighbours")).alias("n"))
    merged = finds.select("_row", F.slice(F.sort_array("n"), 1, index.k).alias("n"))
    none = F.array().cast(kind)
    return own.join(merged, "_row", "left").select("_point.*", F.coalesce("n", none).alias("neighbours"))


def _opened(tree: DataFrame, levels: int) -> DataFrame:
    """``tree`` with ``top`` opened ``levels`` times: the entries at its bottom."""
    for _ in range(levels):
        tree = tree.withColumn("top", F.flatten("top.content"))
    return tree


def _by_content(a: Column, b: Column) -> Column:
    return F.when(a["content"] < b["content"], -1).when(a["content"] > b["content"], 1).otherwise(0)


def _neighbour_type(tree: DataFrame, levels: int) -> T.ArrayType:
    station = _opened(tree, levels).schema["top"].dataType.elementType["content"].dataType
    return T.ArrayType(T.StructType([T.StructField("tie", T.DoubleType()), T.StructField("station", station), T.StructField("dist_miles", T.DoubleType())]))


def _numbers(column) -> np.ndarray:
    """An Arrow column of numbers; NaN where it is null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _in_space(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Places on the unit sphere, where chords take the part of distances."""
    cos = np.cos(phi)
    return np.stack([cos * np.cos(theta), cos * np.sin(theta), np.sin(phi)], axis=1)


def _chord(miles):
    """The chord of great-circle miles."""
    return 2 * np.sin(np.minimum(np.asarray(miles) / (2 * EARTH_RADIUS_MILES), math.pi / 2))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the differences of the rows of ``a`` and ``b``."""
    x, y, z = (a[..., i] - b[..., i] for i in range(3))
    return np.sqrt(x * x + y * y + z * z)


def _full_at(ends: np.ndarray, n: np.ndarray | None, k: int) -> np.ndarray:
    """Within which of ``ends`` (last axis) k stations lie; infinite where there are fewer. Without ``n`` each end holds one."""
    if n is None:
        return np.partition(ends, k - 1, axis=-1)[..., k - 1] if ends.shape[-1] >= k else np.full(ends.shape[:-1], np.inf)
    order = np.argsort(ends, axis=-1)
    full = np.cumsum(n[order], axis=-1) >= k
    first = np.argmax(full, axis=-1)[..., None]
    bound = np.take_along_axis(np.take_along_axis(ends, order, axis=-1), first, axis=-1)
    return np.where(full[..., -1], bound[..., 0], np.inf)


def _near_pairs(points: np.ndarray, places: np.ndarray, radius: np.ndarray | None, n: np.ndarray | None, k: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, entry): for each point the entries that may hold one of its k nearest stations within ``reach``, a chord.

    Points that lie together are held against the entries together: what is too
    far for all of them goes, then they are halved, until the pairs left are few.
    For stations seen from afar it counts how much their distances from two
    points differ from each other, not from what they are at the centre: a
    difference of distances changes by no more than the way times the angle at
    which they are seen. ``radius`` and ``n`` are null for stations.
    """
    pairs = []
    todo = [(np.arange(len(points)), np.arange(len(places)))] if len(points) and len(places) else []
    while todo:
        at, held = todo.pop()
        low, high = points[at].min(axis=0), points[at].max(axis=0)
        centre = (low + high) / 2
        way = _far(points[at], centre).max()
        d = _far(places[held], centre)
        r = 0.0 if radius is None else radius[held]
        bound = min(_full_at(d + r, None if n is None else n[held], k) + 2 * way, reach + way) + SLACK_CHORD
        near = d - r <= bound
        held, d = held[near], d[near]
        if radius is None and len(held) > k:
            inside = places[held]
            middle = (inside.min(axis=0) + inside.max(axis=0)) / 2
            wide = _far(inside, middle).max()
            away = _far(centre, middle) - wide - way
            if away > wide:
                near = d <= _full_at(d, None, k) + 2 * wide * way / away + SLACK_CHORD
                held = held[near]
        if not len(held):
            continue
        if len(at) > LEAF_POINTS and len(at) * len(held) > LEAF_PAIRS or len(at) * len(held) > MOST_PAIRS and len(at) > 1:
            axis = int(np.argmax(high - low))
            order, half = np.argpartition(points[at, axis], len(at) // 2), len(at) // 2
            todo += [(at[order[:half]], held), (at[order[half:]], held)]
            continue
        d = _far(points[at][:, None, :], places[held][None, :, :])
        r = 0.0 if radius is None else radius[held][None, :]
        bound = np.minimum(_full_at(d + r, None if n is None else n[held], k), reach) + SLACK_CHORD
        point, entry = np.nonzero(d - r <= bound[:, None])
        pairs.append((at[point], held[entry]))
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*pairs))


def _lists(owner: np.ndarray, values: pa.Array, size: int) -> pa.Array:
    """``values``, which are in the order of their owners, as one list for each of ``size`` owners."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=size))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _nearest_of(lat: np.ndarray, lon: np.ndarray, entries: pa.StructArray, k: int, max_miles: float) -> pa.ListArray:
    """The ``neighbours`` of each place among entries that are in the order of their stations."""
    phi, theta = np.radians(lat), np.radians(lon)
    to_phi, to_theta, to_cos = (_numbers(entries.field(c)) for c in ("phi", "theta", "cos"))
    sound = np.flatnonzero(np.isfinite(phi) & np.isfinite(theta))
    point, entry = _near_pairs(_in_space(phi[sound], theta[sound]), _in_space(to_phi, to_theta), None, None, k, float(_chord(max_miles)))
    point = sound[point]
    half_lat, half_lon = np.sin((to_phi[entry] - phi[point]) * 0.5), np.sin((to_theta[entry] - theta[point]) * 0.5)
    chord = half_lat * half_lat + np.cos(phi[point]) * to_cos[entry] * (half_lon * half_lon)
    miles = np.arcsin(np.sqrt(np.minimum(1.0, chord))) * (2 * EARTH_RADIUS_MILES)
    tie = np.rint(miles * TIE_SCALE)
    order = np.lexsort((entry, tie, point))
    order = order[miles[order] <= max_miles]
    owner = point[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    order = order[place < k]
    found = pa.StructArray.from_arrays(
        [pa.array(tie[order]), entries.field("content").take(pa.array(entry[order])), pa.array(miles[order])], ["tie", "station", "dist_miles"]
    )
    return _lists(point[order], found, len(lat))


def _one_struct(table: pa.Table) -> pa.StructArray:
    return pa.StructArray.from_arrays([table[c].combine_chunks() for c in table.column_names], table.column_names)


def _neighbour_search(bottom: pa.Table, kind: T.ArrayType, index: StationIndex):
    """(lat, lon) to ``neighbours`` among all stations."""
    entries, k, max_miles = _one_struct(bottom), index.k, index.max_miles

    @F.arrow_udf(kind)
    def search(lat: pa.Array, lon: pa.Array) -> pa.Array:
        return _nearest_of(_numbers(lat), _numbers(lon), entries, k, max_miles)

    return search


def _subtree_search(upper: pa.Table, index: StationIndex):
    """(lat, lon) to the ids of the subtrees that may hold one of the k nearest stations."""
    groups, k, max_miles = _one_struct(upper), index.k, index.max_miles

    @F.arrow_udf("array<bigint>")
    def search(lat: pa.Array, lon: pa.Array) -> pa.Array:
        phi, theta = np.radians(_numbers(lat)), np.radians(_numbers(lon))
        sound = np.flatnonzero(np.isfinite(phi) & np.isfinite(theta))
        places = _in_space(_numbers(groups.field("phi")), _numbers(groups.field("theta")))
        radius, n = _chord(_numbers(groups.field("radius"))), _numbers(groups.field("n"))
        point, entry = _near_pairs(_in_space(phi[sound], theta[sound]), places, radius, n, k, float(_chord(max_miles)))
        order = np.argsort(sound[point], kind="stable")
        return _lists(sound[point][order], groups.field("content").take(pa.array(entry[order])), len(phi))

    return search


def _chunk_search(index: StationIndex):
    """(points, entries of a subtree) to (row, neighbours) of each point; some chunks at a time are held as results."""
    k, max_miles = index.k, index.max_miles

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, entries = batch.columns
            parts, waiting = [], 0
            for i in range(len(batch)):
                own, held = (x.slice(i, 1).flatten() for x in (points, entries))
                found = _nearest_of(_numbers(own.field("_lat")), _numbers(own.field("_lon")), held, k, max_miles)
                parts.append(pa.RecordBatch.from_arrays([own.field("_row"), found], ["_row", "neighbours"]))
                waiting += len(own)
                if waiting >= 1 << CHUNK_BITS or i == len(batch) - 1:
                    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                    parts, waiting = [], 0

    return search


def neighbour_weight(distance: Column) -> Column:
    return F.lit(1.0) / (distance + WEIGHT_SOFTENING)


def weighted_mean(neighbours: Column, field: str) -> Column:
    """Inverse-distance weighted mean of a station field; null without neighbours."""
    start = F.struct(F.lit(0.0).alias("weighted"), F.lit(0.0).alias("weight"))
    return F.when(
        F.size(neighbours) > 0,
        F.aggregate(
            neighbours,
            start,
            lambda acc, n: F.struct(
                (acc["weighted"] + n["station"][field] * neighbour_weight(n["dist_miles"])).alias("weighted"),
                (acc["weight"] + neighbour_weight(n["dist_miles"])).alias("weight"),
            ),
            lambda acc: acc["weighted"] / acc["weight"],
        ),
    )


def neighbour_rows(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (point, neighbour) with rank, distance and normalised weight."""
    total = F.aggregate("neighbours", F.lit(0.0), lambda acc, n: acc + neighbour_weight(n["dist_miles"]))
    return points.select(*keys, total.alias("_total"), F.posexplode("neighbours").alias("_pos", "_n")).select(
        *keys,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_n.dist_miles").alias("dist_miles"),
        (neighbour_weight(F.col("_n.dist_miles")) / F.col("_total")).alias("weight"),
        "_n.station.*",
    )
