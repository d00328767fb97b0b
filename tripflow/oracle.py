"""The same results in plain SQL, each from the provided tables alone."""

from __future__ import annotations

OLD_YEARS = [1995, 1996, 1997, 1998]
NEW_YEARS = [1999, 2000, 2001]
YEARS = OLD_YEARS + NEW_YEARS

ORACLE_SQL: dict[str, str] = {}


def miles(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 3958.7613e0 * asin(sqrt(least(1e0, power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lon2}) - ({lon1})) / 2), 2)))))"
    )


def spread(key: str, factor: int, start: int) -> str:
    return f"({start}e0 + ({key} * {factor} % 300) / 100e0)"


def with_parts(*names: str) -> str:
    """A WITH clause of the named views and the views those need."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dependency in VIEWS[name][0]:
            add(dependency)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in needed) + "\n"


_years = ", ".join(
    f"max(aadt) FILTER (WHERE year = {y}) AS a{y}, max(truck) FILTER (WHERE year = {y}) AS t{y}" for y in YEARS
)
_fc = "CASE WHEN s_suppkey % 17 <> 0 THEN 'FC' || (s_nationkey % 5) END"

VIEWS: dict[str, tuple[list[str], str]] = {
    "volumes": (
        [],
        """SELECT l_suppkey AS station, year(l_shipdate) AS year,
        CASE WHEN (l_suppkey * 7 + year(l_shipdate)) % 11 <> 0 THEN sum(l_quantity) END AS aadt,
        avg(l_discount) * 100 AS truck
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
    ),
    "wide": (["volumes"], f"SELECT station, {_years} FROM volumes GROUP BY station"),
    "old": (
        ["wide"],
        f"""SELECT CAST(s_suppkey AS VARCHAR) AS sid, {_fc} AS fc, wide.* EXCLUDE (station)
        FROM supplier LEFT JOIN wide ON station = s_suppkey WHERE s_suppkey % 13 <> 0""",
    ),
    "new": (
        ["wide"],
        f"""SELECT CAST(s_suppkey AS VARCHAR) AS sid, {_fc} AS fc, {spread('s_suppkey', 37, 32)} AS lat,
        {spread('s_suppkey', 91, -85)} AS lon, wide.* EXCLUDE (station)
        FROM supplier LEFT JOIN wide ON station = s_suppkey WHERE s_suppkey % 19 <> 0""",
    ),
    "attributes": (
        [],
        """SELECT CAST(s_suppkey AS VARCHAR) AS sid, 0.05e0 + s_suppkey % 10 / 100e0 AS k,
        0.5e0 + s_suppkey % 7 / 100e0 AS d, 'T' || (s_suppkey % 3) AS kind FROM supplier
        UNION
        SELECT CAST(s_suppkey AS VARCHAR), 0.05e0 + 0.02e0 + s_suppkey % 10 / 100e0,
        0.5e0 + s_suppkey % 7 / 100e0, 'T9' FROM supplier WHERE s_suppkey % 23 = 0""",
    ),
    "merged": (
        ["old", "new"],
        "SELECT coalesce(old.sid, new.sid) AS sid, coalesce(old.fc, new.fc) AS fc, new.lat, new.lon, "
        + ", ".join([f"old.a{y}, old.t{y}" for y in OLD_YEARS] + [f"new.a{y}, new.t{y}" for y in NEW_YEARS])
        + " FROM old FULL JOIN new ON old.sid = new.sid AND old.fc IS NOT DISTINCT FROM new.fc",
    ),
    "numbered": (["merged"], "SELECT row_number() OVER (ORDER BY sid, fc) AS n, * FROM merged"),
    "yearly": (
        ["numbered"],
        "\nUNION ALL ".join(f"SELECT n, {y} AS year, a{y} AS aadt, t{y} AS truck FROM numbered" for y in YEARS),
    ),
    "statistics": (
        ["yearly"],
        """SELECT n, CASE WHEN count(aadt) FILTER (WHERE year >= 1996) >= 2
            THEN regr_slope(aadt, year) FILTER (WHERE year >= 1996) END AS slope,
        avg(aadt) FILTER (WHERE year >= 1999) AS mean3, stddev_pop(aadt) FILTER (WHERE year >= 1999) AS std3,
        avg(truck) AS truck_mean, max(aadt) FILTER (WHERE year = 2001) AS latest,
        max(truck) FILTER (WHERE year = 2001) AS truck_latest FROM yearly GROUP BY n""",
    ),
    "features": (
        ["numbered", "statistics", "attributes"],
        """SELECT numbered.sid, fc, lat, lon, k, d, kind, statistics.* EXCLUDE (n) FROM numbered
        JOIN statistics ON statistics.n = numbered.n LEFT JOIN attributes ON attributes.sid = numbered.sid""",
    ),
    "labelled": (
        ["features"],
        """SELECT *, CASE WHEN latest >= (SELECT quantile_cont(latest, 0.75) FROM features) THEN 1 ELSE 0 END AS label
        FROM features""",
    ),
    "classes": (
        ["labelled"],
        "SELECT label, count(*) AS c, sum(count(*)) OVER () AS total FROM labelled GROUP BY label",
    ),
    "sizes": (
        ["classes"],
        """SELECT label, c - base - CASE WHEN row_number() OVER (ORDER BY share - base DESC, label)
            <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS n_test
        FROM (SELECT *, total - ceil(total * 0.2e0) AS n_train, c * (total - ceil(total * 0.2e0)) / total AS share,
              floor(c * (total - ceil(total * 0.2e0)) / total) AS base FROM classes)""",
    ),
    "parted": (
        ["labelled", "sizes"],
        """SELECT l.*, row_number() OVER (PARTITION BY l.label ORDER BY
            md5(concat_ws(':', '42', l.sid, coalesce(fc, ''), coalesce(ktext, ''), coalesce(dtext, ''), coalesce(kind, ''))))
            <= n_test AS is_test
        FROM (SELECT *, CAST(k AS VARCHAR) AS ktext, CAST(d AS VARCHAR) AS dtext FROM labelled) l
        JOIN sizes ON sizes.label = l.label""",
    ),
    "stations": (
        [],
        f"""SELECT s_suppkey AS station_id, {spread('s_suppkey', 37, 32)} AS lat, {spread('s_suppkey', 91, -85)} AS lon,
        s_suppkey % 10 / 10e0 AS probability FROM supplier""",
    ),
    "trips": (
        [],
        f"""SELECT o_orderkey AS trip_id,
        TIMESTAMP '2024-01-01' + to_minutes(o_orderkey * 977 % 43200) AS request_ts,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'I-75' WHEN '2' THEN 'SR-400' WHEN '3' THEN 'GA-316'
            WHEN '4' THEN 'US-41' ELSE 'PEACHTREE ST' END AS road,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 70e0 WHEN '5' THEN 50e0 ELSE 45e0 END AS freeflow,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 1.1e0 ELSE 1.2e0 END AS path_factor,
        {spread('o_custkey', 53, 32)} AS olat, {spread('o_custkey', 29, -85)} AS olon,
        {spread('o_orderkey', 41, 32)} AS dlat, {spread('o_orderkey', 67, -85)} AS dlon,
        o_orderkey % 4 * 15 AS leave_in, o_orderkey % 6 <> 0 AS live,
        CASE o_orderkey % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'geoapify' WHEN 2 THEN 'ors' WHEN 3 THEN 'google'
            ELSE 'auto' END AS router, o_orderkey % 5 <> 0 AS encoded_wanted
        FROM orders""",
    ),
    "places": (
        ["trips"],
        f"""SELECT *, (olat + dlat) / 2 AS mlat, (olon + dlon) / 2 AS mlon,
        {miles('olat', 'olon', 'dlat', 'dlon')} AS straight,
        request_ts + to_minutes(leave_in) AS depart FROM trips""",
    ),
    "pairs": (
        ["places", "stations"],
        f"""SELECT trip_id, station_id, probability, {miles('mlat', 'mlon', 'lat', 'lon')} AS dist
        FROM places, stations""",
    ),
    "near": (
        ["pairs"],
        """SELECT *, 1 / (dist + 1e-3) AS w,
        row_number() OVER (PARTITION BY trip_id ORDER BY round_even(dist * 1e8, 0), station_id) AS rank
        FROM pairs WHERE dist <= 25 QUALIFY rank <= 10""",
    ),
    "base": (
        ["places", "near"],
        """SELECT places.*, p_base FROM places LEFT JOIN
        (SELECT trip_id, sum(probability * w) / sum(w) AS p_base FROM near GROUP BY trip_id) x USING (trip_id)""",
    ),
    "timed": (
        ["base"],
        """SELECT *, CASE WHEN p_base IS NOT NULL THEN greatest(0e0, least(1e0, p_base + CASE
            WHEN hour(depart - INTERVAL 5 HOUR) BETWEEN 7 AND 9 THEN 0.1e0
            WHEN hour(depart - INTERVAL 5 HOUR) BETWEEN 16 AND 18 THEN 0.12e0 ELSE 0e0 END)) END AS p_time FROM base""",
    ),
    "weather": (
        [],
        """SELECT event_id, ts, event_type, value,
        CASE event_type WHEN 'error' THEN 'Thunderstorms' WHEN 'signup' THEN 'Light Rain' WHEN 'view' THEN 'Sunny'
            WHEN 'click' THEN 'Mostly Cloudy' ELSE 'Snow Showers' END AS short,
        CASE WHEN event_id % 9 = 0 THEN 'calm' ELSE CAST(CAST(floor(value) AS BIGINT) % 35 AS VARCHAR) || ' mph' END AS wind,
        CASE WHEN event_id % 9 = 0 THEN 0e0 ELSE CAST(CAST(floor(value) AS BIGINT) % 35 AS DOUBLE) END AS wind_mph,
        CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    ),
    "moments": (
        ["weather"],
        """SELECT ts AS at, lower(short) AS description,
        CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN 0.08e0 ELSE 0e0 END
        + CASE WHEN wind_mph > 20 THEN 0.03e0 ELSE 0e0 END AS bump FROM weather""",
    ),
    "incidents": (
        ["weather"],
        """SELECT ts, event_id, CASE WHEN k % 5 <> 0 THEN CAST(k % 4 AS VARCHAR) END AS lanes FROM weather
        WHERE event_type = 'error'""",
    ),
    "summary": (
        ["incidents"],
        """SELECT count(*) AS events, coalesce(bool_or(CAST(lanes AS DOUBLE) >= 1), false) AS any_lane,
        coalesce(bool_or(CAST(lanes AS DOUBLE) >= 2), false) AS two_lanes FROM incidents""",
    ),
    "conditions": (
        ["summary"],
        """SELECT *, CASE WHEN events > 0 THEN 0.05e0 + CASE WHEN any_lane THEN 0.1e0 ELSE 0e0 END
        + CASE WHEN two_lanes THEN 0.1e0 ELSE 0e0 END END AS incident_bump FROM summary""",
    ),
    "answers": (
        ["trips"],
        """SELECT trip_id, 'geoapify' AS provider, 1 AS priority, trip_id % 9 <> 0 AS ok,
            CASE WHEN trip_id % 9 = 0 THEN 'no features' END AS error,
            trip_id % 1000 * 100e0 AS metres, trip_id % 777 * 6e0 AS seconds, olat, olon, dlat, dlon
            FROM trips WHERE trip_id % 3 = 0
        UNION ALL SELECT trip_id, 'ors', 2, trip_id % 10 <> 0, CASE WHEN trip_id % 10 = 0 THEN 'no features' END,
            trip_id % 1000 * 100e0, trip_id % 777 * 6e0, olat, olon, dlat, dlon FROM trips WHERE trip_id % 2 = 0
        UNION ALL SELECT trip_id, 'google', 3, trip_id % 13 <> 0, CASE WHEN trip_id % 13 = 0 THEN 'ZERO_RESULTS' END,
            trip_id % 1000 * 100e0 + 50, trip_id % 777 * 6e0, olat, olon, dlat, dlon FROM trips WHERE trip_id % 7 <> 0""",
    ),
    "asked": (
        ["trips", "answers"],
        """SELECT trip_id, a.provider, a.ok, a.error, a.metres / 1609.344e0 AS miles, a.seconds / 60 AS minutes, router
        FROM trips LEFT JOIN answers a USING (trip_id)
        WHERE a.trip_id IS NULL OR true
        QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY
            CASE WHEN a.provider = router OR router = 'auto' THEN 0 ELSE 1 END, a.priority) = 1""",
    ),
    "routed": (
        ["asked"],
        """SELECT trip_id, router,
        CASE WHEN provider = router OR router = 'auto' THEN coalesce(ok, false) ELSE false END AS ok, provider,
        CASE WHEN router = 'none' THEN 'routing disabled'
            WHEN provider IS NULL OR NOT (provider = router OR router = 'auto') THEN 'no routing keys set'
            ELSE error END AS route_error, miles, minutes FROM asked""",
    ),
    "after": (
        ["places", "timed", "moments", "conditions"],
        # DuckDB's least and greatest skip nulls; a trip without a station must stay null
        """SELECT t.*, CASE WHEN p_time IS NOT NULL THEN least(1e0, greatest(0e0, p_time + w.bump + incident_bump)) END AS p_live,
        w.bump AS nws, incident_bump, events
        FROM timed t JOIN nearest USING (trip_id) JOIN moments w ON w.at = nearest.at, conditions""",
    ),
    "runs": (
        ["weather"],
        """SELECT *, epoch_us(ts) AS at_micros, event_id % 11 = 0 AS no_weather, event_id % 7 = 0 AS no_incidents,
        event_id % 5 AS shape, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp,
        (k + 3000) / 100e0 AS ilat, (-8000 - k) / 100e0 AS ilon FROM weather""",
    ),
    "found": (
        ["runs"],
        """SELECT at_micros, CAST(event_id AS VARCHAR) AS id, CAST(k % 4 AS VARCHAR) AS lanes,
            CASE WHEN shape = 3 THEN NULL ELSE ilat END AS lat, CASE WHEN shape = 3 THEN NULL ELSE ilon END AS lon
            FROM runs WHERE NOT no_incidents AND shape < 4
        UNION ALL SELECT at_micros, CAST(event_id AS VARCHAR), CAST(k % 4 AS VARCHAR), ilat, ilon FROM runs
            WHERE NOT no_incidents AND shape = 1""",
    ),
    "scores": ([], "SELECT quality AS label, doc_id * 31 % 97 / 97e0 AS score FROM labels"),
    "ranked": (
        ["scores"],
        """SELECT score, sum(label) AS pos, sum(1 - label) AS neg,
        sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(sum(1 - label)) OVER (ORDER BY score DESC) AS fp,
        sum(sum(label)) OVER () AS p, sum(sum(1 - label)) OVER () AS n FROM scores GROUP BY score""",
    ),
    "curve": (
        ["ranked"],
        """SELECT *, tp / (tp + fp) AS precision, tp / p AS recall,
        lag(tp / (tp + fp), 1, 1e0) OVER (ORDER BY score DESC) AS precision_before,
        lag(tp / p, 1, 0e0) OVER (ORDER BY score DESC) AS recall_before FROM ranked""",
    ),
}


def nearest(points: str, ts: str) -> str:
    """Nearest moment per point from the last before and the first after; the earlier on ties."""
    return f"""nearest AS (
        SELECT b.trip_id, CASE WHEN b.at IS NULL THEN a.at WHEN a.at IS NULL THEN b.at
            WHEN epoch_us(b.{ts}) - epoch_us(b.at) <= epoch_us(a.at) - epoch_us(b.{ts}) THEN b.at ELSE a.at END AS at
        FROM (SELECT p.trip_id, p.{ts}, m.at FROM {points} p ASOF LEFT JOIN moments m ON p.{ts} >= m.at) b
        JOIN (SELECT p.trip_id, m.at FROM {points} p ASOF LEFT JOIN moments m ON p.{ts} <= m.at) a USING (trip_id))"""


def with_nearest(points: str, ts: str, *later: str) -> str:
    """WITH clause in which ``nearest`` precedes the views built on it."""
    clause = with_parts(points, "moments", "conditions").rstrip() + ",\n" + nearest(points, ts)
    for name in later:
        clause += f",\n{name} AS ({VIEWS[name][1]})"
    return clause + "\n"


def add(name: str, sql: str) -> None:
    ORACLE_SQL[name] = sql


add(
    "header_clean",
    with_parts("new")
    + "SELECT sid AS STATION_ID, fc AS FUNCTIONAL_CLASS, "
    + ", ".join(f"CAST(a{y} AS VARCHAR) AS AADT_{y}" for y in NEW_YEARS)
    + " FROM new",
)
add(
    "csv_scan",
    with_parts("old")
    + "SELECT sid AS STATION_ID, fc AS FUNCTIONAL_CLASS, "
    + ", ".join(f"a{y} AS AADT_{y}, round(t{y}, 6) AS TRUCK_{y}" for y in OLD_YEARS)
    + " FROM old",
)
add(
    "numeric_coerce",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 IN (0, 6, 7) THEN o_totalprice END AS number FROM orders",
)
add(
    "coordinate_choice",
    """SELECT s_suppkey AS station_id, 30e0 + s_suppkey % 7 AS serving_lat, -80e0 - s_suppkey % 3 AS lon,
    40e0 + s_suppkey % 5 AS training_lat FROM supplier""",
)
add(
    "station_full_join",
    with_parts("merged")
    + """SELECT sid AS STATION_ID, fc AS FUNCTIONAL_CLASS, CAST(a1995 AS VARCHAR) AS AADT_1995,
    CAST(a1998 AS VARCHAR) AS AADT_1998, CAST(a1999 AS VARCHAR) AS AADT_1999, CAST(a2001 AS VARCHAR) AS AADT_2001,
    CAST(lat AS VARCHAR) AS LATITUDE FROM merged""",
)
add(
    "typed_keys",
    """WITH old AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 4 > 1 THEN 'FC' || (s_suppkey % 4) END AS fc FROM supplier WHERE s_suppkey % 13 <> 0),
    new AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 4 > 1 THEN 'FC' || (s_suppkey % 4) END AS fc FROM supplier WHERE s_suppkey % 19 <> 0),
    attributes AS (SELECT s_suppkey AS s, '0.1' AS k, 'T' AS kind FROM supplier
        UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 23 = 0)
    SELECT format('{:.1f}', CAST(coalesce(old.s, new.s) AS DOUBLE)) AS STATION_ID, coalesce(old.fc, new.fc) AS FUNCTIONAL_CLASS,
    CAST(old.s AS VARCHAR) AS AADT_1995, CAST(new.s AS VARCHAR) AS AADT_2001, k AS KFACTOR, kind AS STATION_TYPE, '1998' AS lost_years
    FROM old FULL JOIN new ON old.s = new.s LEFT JOIN attributes a ON a.s = coalesce(old.s, new.s)""",
)
add(
    "attribute_distinct",
    with_parts("attributes")
    + """SELECT sid AS STATION_ID, CAST(k AS VARCHAR) AS KFACTOR, CAST(d AS VARCHAR) AS DFACTOR, kind AS STATION_TYPE
    FROM attributes""",
)
add(
    "station_attr_join",
    with_parts("merged", "attributes")
    + """SELECT merged.sid AS STATION_ID, fc AS FUNCTIONAL_CLASS, CAST(k AS VARCHAR) AS KFACTOR,
    CAST(d AS VARCHAR) AS DFACTOR, kind AS STATION_TYPE FROM merged LEFT JOIN attributes USING (sid)""",
)
for _name, _columns in {
    "station_slope": "round(slope, 6) AS AADT_TREND_SLOPE",
    "station_rolling": "round(mean3, 6) AS AADT_MEAN_3YR, round(std3, 6) AS AADT_STD_3YR",
    "station_truck_mean": "round(truck_mean, 6) AS TRUCK_PCT_MEAN",
    "station_latest": "round(latest, 6) AS AADT_LATEST, round(truck_latest, 6) AS TRUCK_PCT_LATEST",
}.items():
    add(_name, with_parts("features") + f"SELECT sid AS STATION_ID, kind AS STATION_TYPE, {_columns} FROM features")
add(
    "station_features",
    with_parts("features")
    + """SELECT sid AS STATION_ID, round(lat, 6) AS LAT, round(lon, 6) AS LON, round(mean3, 6) AS AADT_MEAN_3YR,
    round(std3, 6) AS AADT_STD_3YR, round(slope, 6) AS AADT_TREND_SLOPE, round(truck_mean, 6) AS TRUCK_PCT_MEAN,
    round(truck_latest, 6) AS TRUCK_PCT_LATEST, round(k, 6) AS KFACTOR, round(d, 6) AS DFACTOR,
    fc AS FUNCTIONAL_CLASS, kind AS STATION_TYPE FROM features WHERE lat IS NOT NULL AND lon IS NOT NULL""",
)
add(
    "feature_contract",
    with_parts("stations")
    + "SELECT station_id, lat AS LAT, "
    + ", ".join(
        f"CAST(NULL AS DOUBLE) AS {c}"
        for c in (
            "LON AADT_MEAN_3YR AADT_STD_3YR AADT_TREND_SLOPE TRUCK_PCT_MEAN TRUCK_PCT_LATEST KFACTOR DFACTOR".split()
        )
    )
    + ", CAST(NULL AS VARCHAR) AS FUNCTIONAL_CLASS, CAST(NULL AS VARCHAR) AS STATION_TYPE FROM stations",
)
add("label_p75", with_parts("labelled") + "SELECT sid AS STATION_ID, kind AS STATION_TYPE, CAST(label AS BIGINT) AS label FROM labelled")
add(
    "stratified_split",
    """WITH classes AS (SELECT o_orderstatus AS s, count(*) AS c, sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
    shares AS (SELECT *, total - ceil(total * 0.2e0) AS n_train, c * (total - ceil(total * 0.2e0)) / total AS share FROM classes),
    sizes AS (SELECT s, c - floor(share) - CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, s)
        <= n_train - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS n_test FROM shares)
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus
        ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) <= n_test AS is_test
    FROM orders JOIN sizes ON s = o_orderstatus""",
)
_numeric = {
    "LAT": "lat",
    "LON": "lon",
    "AADT_MEAN_3YR": "mean3",
    "AADT_STD_3YR": "std3",
    "AADT_TREND_SLOPE": "slope",
    "TRUCK_PCT_MEAN": "truck_mean",
    "TRUCK_PCT_LATEST": "truck_latest",
    "KFACTOR": "k",
    "DFACTOR": "d",
}
add(
    "impute_median",
    with_parts("parted")
    + "\nUNION ALL ".join(
        f"SELECT '{n}' AS name, round(median({c}), 6) AS median FROM parted WHERE NOT is_test" for n, c in _numeric.items()
    ),
)
_mode = "SELECT {c} FROM parted WHERE NOT is_test AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"
add(
    "impute_mode",
    with_parts("parted")
    + f"""SELECT 'FUNCTIONAL_CLASS' AS name, ({_mode.format(c='fc')}) AS mode
    UNION ALL SELECT 'STATION_TYPE', ({_mode.format(c='kind')})""",
)
add(
    "impute_filled",
    with_parts("parted")
    + f"""SELECT coalesce(fc, ({_mode.format(c='fc')})) AS FUNCTIONAL_CLASS,
    coalesce(kind, ({_mode.format(c='kind')})) AS STATION_TYPE, count(*) AS n,
    round(sum(coalesce(k, (SELECT median(k) FROM parted WHERE NOT is_test))), 6) AS k_sum,
    round(sum(coalesce(mean3, (SELECT median(mean3) FROM parted WHERE NOT is_test))), 4) AS mean_sum
    FROM parted GROUP BY 1, 2""",
)
add(
    "onehot_features",
    with_parts("parted")
    + f""", filled AS (SELECT 'FUNCTIONAL_CLASS' AS feature, coalesce(fc, ({_mode.format(c='fc')})) AS category, is_test FROM parted
        UNION ALL SELECT 'STATION_TYPE', coalesce(kind, ({_mode.format(c='kind')})), is_test FROM parted),
    known AS (SELECT feature, category, row_number() OVER (PARTITION BY feature ORDER BY category) AS position,
        count(*) OVER (PARTITION BY feature) AS width FROM (SELECT DISTINCT feature, category FROM filled WHERE NOT is_test)),
    widths AS (SELECT DISTINCT feature, width FROM known)
    SELECT feature, category, coalesce(position, 0) AS position, widths.width, count(*) AS n
    FROM filled JOIN widths USING (feature) LEFT JOIN known USING (feature, category) GROUP BY ALL""",
)
add(
    "model_roundtrip",
    with_parts("features")
    + """SELECT sid AS STATION_ID, true AS in_range, true AS same_after_loading
    FROM features WHERE lat IS NOT NULL AND lon IS NOT NULL""",
)
add(
    "contract_record",
    """SELECT 'LAT,LON,AADT_MEAN_3YR,AADT_STD_3YR,AADT_TREND_SLOPE,TRUCK_PCT_MEAN,TRUCK_PCT_LATEST,KFACTOR,DFACTOR'
    AS numeric_features, 'FUNCTIONAL_CLASS,STATION_TYPE' AS categorical_features, 'HIGH_CONGESTION_PROXY' AS label,
    '1 if AADT_2001 >= 75th percentile; else 0' AS label_definition, CAST(2001 AS BIGINT) AS latest_year""",
)
add(
    "roc_auc",
    with_parts("ranked")
    + "SELECT round(sum(pos * (n - fp + neg / 2e0)) / (max(p) * max(n)), 9) AS roc_auc FROM ranked",
)
add(
    "pr_curve",
    with_parts("curve")
    + "SELECT round(score, 6) AS score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve",
)
add(
    "pr_auc",
    with_parts("curve")
    + "SELECT round(sum((recall - recall_before) * (precision + precision_before) / 2), 9) AS pr_auc FROM curve",
)
add(
    "metrics_record",
    with_parts("ranked", "curve", "scores")
    + """, c AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
        count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
        count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM scores)
    SELECT (SELECT round(sum(pos * (n - fp + neg / 2e0)) / (max(p) * max(n)), 6) FROM ranked) AS roc_auc,
    (SELECT round(sum((recall - recall_before) * (precision + precision_before) / 2), 6) FROM curve) AS pr_auc,
    round(tn / (tn + fp), 6) AS recall_0, round(tp / (tp + fp), 6) AS precision_1,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1_1, CAST(tp + fn AS DOUBLE) AS support_1 FROM c""",
)
add(
    "classification_report",
    with_parts("scores")
    + """, c AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
        count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
        count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM scores),
    m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
        tn + fp AS s0, tp + fn AS s1, (tn + tp) / (tn + tp + fn + fp) AS acc FROM c),
    f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, s0 + s1 AS s FROM m)
    SELECT '0' AS row, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM f
    UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f
    UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), s FROM f
    UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s FROM f
    UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / s, 6), round((r0 * s0 + r1 * s1) / s, 6),
        round((f0 * s0 + f1 * s1) / s, 6), s FROM f""",
)
add(
    "request_validate",
    with_parts("trips")
    + """, k AS (SELECT *, CASE WHEN trip_id % 11 = 0 THEN 1 WHEN trip_id % 13 = 0 THEN 2 WHEN trip_id % 17 = 0 THEN 3
        WHEN trip_id % 19 = 0 THEN 4 ELSE 5 END AS kind FROM trips)
    SELECT trip_id, CASE kind WHEN 4 THEN 'US-1' WHEN 5 THEN
        CASE road WHEN 'GA-316' THEN 'ga-316' WHEN 'PEACHTREE ST' THEN 'Peachtree St' ELSE road END END AS roadway,
    CASE kind WHEN 4 THEN 33.5e0 WHEN 5 THEN olat END AS origin_lat,
    CASE kind WHEN 4 THEN -84.5e0 WHEN 5 THEN dlon END AS destination_lon,
    CAST(CASE kind WHEN 4 THEN 0 WHEN 5 THEN leave_in END AS INTEGER) AS leave_in_minutes,
    CASE kind WHEN 4 THEN false WHEN 5 THEN live END AS live,
    CASE kind WHEN 4 THEN 'ors' WHEN 5 THEN 'auto' END AS router,
    CASE WHEN kind >= 4 THEN 'encoded' END AS polyline_format,
    CASE WHEN kind = 1 THEN 'Invalid or missing JSON body' WHEN kind <= 3 THEN
        'Payload must include roadway, origin{lat,lon}, destination{lat,lon}' END AS reason FROM k""",
)
add(
    "haversine",
    with_parts("places")
    + "SELECT trip_id, round(straight, 6) AS miles, round(mlat, 6) AS mid_lat, round(mlon, 6) AS mid_lon FROM places",
)
add("freeflow_speed", with_parts("trips") + "SELECT trip_id, freeflow AS freeflow_mph, path_factor FROM trips")
add(
    "knn_stations",
    with_parts("near")
    + """SELECT trip_id, rank, station_id, round(dist, 6) AS dist_miles,
    round(w / sum(w) OVER (PARTITION BY trip_id), 6) AS weight FROM near""",
)
add(
    "knn_close",
    with_parts("pairs")
    + "SELECT trip_id, least(10, count(*) FILTER (WHERE dist <= 2)) AS stations FROM pairs GROUP BY trip_id",
)
add(
    "knn_tight_group",
    with_parts("places", "stations")
    + f"""SELECT trip_id, station_id, round(dist, 6) AS dist_miles,
    row_number() OVER (PARTITION BY trip_id ORDER BY round_even(dist * 1e8, 0), station_id) AS rank
    FROM (SELECT trip_id, station_id, {miles('mlat', 'mlon', '(33.5e0 + (station_id * 37 % 300) / 300000e0)', '(-83.5e0 + (station_id * 91 % 300) / 300000e0)')} AS dist
        FROM places, stations)
    WHERE dist <= 60 QUALIFY rank <= 10""",
)
add(
    "knn_stored_index",
    with_parts("places", "near")
    + """SELECT trip_id, coalesce(string_agg(CAST(station_id AS VARCHAR), ',' ORDER BY rank), '') AS stations
    FROM places LEFT JOIN near USING (trip_id) GROUP BY trip_id""",
)
add("idw_probability", with_parts("base") + "SELECT trip_id, round(p_base, 6) AS p_base FROM base")
add(
    "rush_hour_bump",
    with_parts("places")
    + """SELECT trip_id, strftime(depart, '%Y-%m-%d %H:%M:%S') AS depart_utc,
    CASE WHEN hour(depart - INTERVAL 5 HOUR) BETWEEN 7 AND 9 THEN 0.1e0
        WHEN hour(depart - INTERVAL 5 HOUR) BETWEEN 16 AND 18 THEN 0.12e0 ELSE 0e0 END AS bump FROM places""",
)
add(
    "forecast_nearest",
    with_nearest("places", "request_ts")
    + """SELECT trip_id, epoch_us(m.at) AS at_micros, description FROM nearest JOIN moments m ON m.at = nearest.at""",
)
add(
    "forecast_containing",
    with_parts("runs")
    + """SELECT at_micros, CAST(1 AS BIGINT) AS position, short, CAST(k AS DOUBLE) AS temperature
    FROM runs WHERE NOT no_weather""",
)
add(
    "weather_bump",
    with_parts("weather")
    + """SELECT event_id, wind_mph AS wind,
    round(CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN 0.08e0 ELSE 0e0 END
        + CASE WHEN wind_mph > 20 THEN 0.03e0 ELSE 0e0 END, 4) AS bump,
    event_type IN ('error', 'signup', 'purchase') AS precipitation FROM weather""",
)
add(
    "incident_summary",
    with_parts("conditions")
    + "SELECT events, any_lane, two_lanes, round(incident_bump, 4) AS bump FROM conditions",
)
add(
    "live_bump",
    with_nearest("places", "request_ts")
    + """SELECT p.trip_id, live AS live_used, CASE WHEN live THEN round(bump, 3) END AS nws_bump,
    CASE WHEN live THEN round(incident_bump, 3) END AS ga511_bump, CASE WHEN live THEN events END AS ga511_events,
    round(CASE WHEN live THEN least(1e0, p.trip_id % 90 / 100e0 + bump + incident_bump) ELSE p.trip_id % 90 / 100e0 END, 6) AS p_final
    FROM places p JOIN nearest USING (trip_id) JOIN moments m ON m.at = nearest.at, conditions""",
)
_scored = (
    with_nearest("timed", "depart", "after").rstrip()
    + ",\n"
    + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ("answers", "asked", "routed"))
    + """, final AS (SELECT a.*, CASE WHEN live THEN p_live ELSE p_time END AS p_final, ok, provider, route_error,
        minutes, straight * path_factor AS estimate,
        CASE WHEN ok AND miles <> 0 THEN miles ELSE straight * path_factor END AS route_miles
        FROM after a JOIN routed r USING (trip_id)),
    eta AS (SELECT *, CASE WHEN p_final IS NOT NULL THEN greatest(5e0, freeflow * (1 - 0.4e0 * p_final)) END AS mph FROM final)
    """
)
add(
    "trip_eta",
    _scored
    + """SELECT trip_id, round(p_base, 5) AS p_base, round(p_time, 5) AS p_time, round(p_final, 5) AS p_final,
    round(mph, 5) AS effective_mph, round(route_miles, 4) AS route_miles,
    round(route_miles / mph * 60, 4) AS eta_minutes FROM eta""",
)


def step_text(step: str) -> str:
    """Polyline text of one signed step, chunk by chunk."""
    zigzag = f"(CASE WHEN ({step}) < 0 THEN -2 * ({step}) - 1 ELSE 2 * ({step}) END)"
    parts = []
    for i in range(6):
        rest = f"({zigzag} // {32**i})"
        char = f"chr(CAST({rest} % 32 + CASE WHEN {rest} > 31 THEN 32 ELSE 0 END + 63 AS INTEGER))"
        parts.append(char if i == 0 else f"CASE WHEN {rest} > 0 THEN {char} ELSE '' END")
    return "(" + " || ".join(parts) + ")"


def grid(x: str) -> str:
    return f"CAST(round_even(({x}) * 1e5, 0) AS BIGINT)"


_line = (
    step_text(grid("olat")) + " || " + step_text(grid("olon")) + " || "
    + step_text(f"{grid('dlat')} - {grid('olat')}") + " || " + step_text(f"{grid('dlon')} - {grid('olon')}")
)


def number_text(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


_pairs = (
    "'[[' || " + number_text("olon") + " || ',' || " + number_text("olat") + " || '],[' || "
    + number_text("dlon") + " || ',' || " + number_text("dlat") + " || ']]'"
)
add(
    "trip_record",
    _scored
    + f"""SELECT trip_id, CASE WHEN ok THEN provider ELSE 'fallback' END AS provider,
    round(CASE WHEN ok THEN route_miles ELSE estimate END, 3) AS distance_miles,
    CASE WHEN ok THEN round(minutes, 1) END AS base_duration_minutes,
    CASE WHEN encoded_wanted THEN CASE WHEN ok AND provider = 'google' THEN 'abc' ELSE {_line} END END AS encoded,
    CASE WHEN NOT encoded_wanted THEN CASE WHEN ok AND provider = 'google' THEN '[]' ELSE {_pairs} END END AS coordinates,
    route_error, round(p_final, 4) AS probability, live AS live_used FROM eta""",
)
add(
    "output_round",
    """SELECT l_extendedprice, count(*) AS n, CAST(format('{:.1f}', l_extendedprice) AS DOUBLE) AS one,
    CAST(format('{:.3f}', l_extendedprice / 1000) AS DOUBLE) AS three,
    CAST(format('{:.2f}', -l_extendedprice / 100) AS DOUBLE) AS two FROM lineitem GROUP BY l_extendedprice""",
)
add(
    "route_normalise",
    with_parts("answers")
    + f"""SELECT trip_id, provider, ok, CASE WHEN ok THEN round(metres / 1609.344e0, 6) END AS distance_miles,
    CASE WHEN ok THEN round(seconds / 60, 6) END AS duration_minutes,
    CAST(CASE WHEN ok AND provider <> 'google' THEN 2 END AS BIGINT) AS points,
    CASE WHEN ok AND provider <> 'google' THEN round(olat, 6) END AS first_lat,
    CASE WHEN NOT ok THEN NULL WHEN provider = 'google' THEN 'abc' ELSE {_line} END AS encoded, error FROM answers""",
)
add(
    "route_fallback",
    with_parts("routed")
    + """SELECT trip_id, CASE WHEN ok THEN provider ELSE 'fallback' END AS provider,
    round(CASE WHEN ok AND miles <> 0 THEN miles ELSE 1.5e0 END, 6) AS miles, route_error FROM routed""",
)
add(
    "route_leg_sum",
    """SELECT l_orderkey,
    round(sum(CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice ELSE 0 END) / 1609.344e0, 6) AS distance_miles,
    round(sum(l_quantity) / 60, 6) AS duration_minutes FROM lineitem GROUP BY l_orderkey""",
)
_order = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
_points = f"""WITH points AS (SELECT l_orderkey AS route_id, {spread('l_partkey', 7, 32)} AS lat,
    -85e0 + l_extendedprice / 100000e0 AS lon,
    row_number() OVER (PARTITION BY l_orderkey {_order}) AS seq FROM lineitem)"""
add(
    "polyline_encode",
    _points
    + f""", steps AS (SELECT route_id, seq,
        {grid('lat')} - lag({grid('lat')}, 1, 0) OVER (PARTITION BY route_id ORDER BY seq) AS dlat,
        {grid('lon')} - lag({grid('lon')}, 1, 0) OVER (PARTITION BY route_id ORDER BY seq) AS dlon FROM points)
    SELECT route_id, string_agg({step_text('dlat')} || {step_text('dlon')}, '' ORDER BY seq) AS encoded
    FROM steps GROUP BY route_id""",
)
add(
    "geojson_line",
    _points
    + """SELECT route_id, '{"type":"LineString","coordinates":[' || string_agg('[' ||
        CAST(CAST(format('{:.4f}', lon) AS DOUBLE) AS VARCHAR) || ',' ||
        CAST(CAST(format('{:.2f}', lat) AS DOUBLE) AS VARCHAR) || ']', ',' ORDER BY seq) || ']}' AS geojson
    FROM points GROUP BY route_id""",
)
add(
    "forecast_rows",
    with_parts("runs")
    + """SELECT at_micros, CAST(0 AS BIGINT) AS position,
        strftime(ts + INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M:%S.%fZ') AS startTime, CAST(k + 1 AS DOUBLE) AS temperature,
        wind AS windSpeed, CAST(NULL AS VARCHAR) AS windDirection, 'Hail later' AS shortForecast
        FROM runs WHERE NOT no_weather
    UNION ALL SELECT at_micros, 1, strftime(CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 1 MINUTE
        ELSE ts + INTERVAL 2 MINUTE END, '%Y-%m-%dT%H:%M:%S.%fZ'), k, wind, NULL, short FROM runs WHERE NOT no_weather""",
)
add(
    "alert_rows",
    with_parts("runs")
    + """SELECT at_micros, 'A' || event_id AS id, event_type AS event, 'Severe' AS severity,
        CAST(NULL AS VARCHAR) AS areaDesc FROM runs WHERE NOT no_weather AND event_id % 3 < 2
    UNION ALL SELECT at_micros, 'A' || event_id, event_type, 'Severe', NULL FROM runs
        WHERE NOT no_weather AND event_id % 3 = 0""",
)
add("incident_flatten", with_parts("found") + "SELECT at_micros, count(*) AS objects FROM found GROUP BY at_micros")
_found = "SELECT at_micros, id, lanes AS lanesBlocked, lat, lon, CAST(NULL AS VARCHAR) AS headline FROM found"
add("incident_fields", with_parts("found") + _found)
add("stream_ingest", with_parts("found") + _found)
add("log_two_streams", with_parts("found") + f"{_found} UNION ALL {_found}")
add(
    "retention_then_ingest",
    with_parts("found") + f"{_found} UNION ALL {_found} WHERE at_micros >= epoch_us(TIMESTAMP '2024-01-21')",
)
add(
    "coordinate_resolve",
    with_parts("weather")
    + """, c AS (SELECT event_id, k, k % 2 <> 0 AND k % 3 <> 0 AS flat FROM weather),
    d AS (SELECT *, NOT flat AND k % 7 <> 0 AND k % 11 = 0 AS bad FROM c)
    SELECT event_id, CAST(CASE WHEN bad THEN NULL WHEN flat THEN k + 1 WHEN k % 5 <> 0 THEN k + 3 ELSE k + 5 END AS DOUBLE) AS lat,
    CAST(CASE WHEN bad THEN NULL WHEN flat THEN k + 2 WHEN k % 7 <> 0 THEN k + 4 ELSE k + 6 END AS DOUBLE) AS lon FROM d""",
)
add(
    "iso_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso,
    CASE WHEN event_id % 7 <> 0 THEN strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S+00:00') END AS parsed FROM events""",
)
_heartbeat = """SELECT r.at_micros, NOT no_weather AS nws_ok, CASE WHEN NOT no_weather THEN short END AS wx_short,
    CASE WHEN NOT no_weather THEN CAST(k AS DOUBLE) END AS wx_temp, CASE WHEN NOT no_weather THEN wind END AS wx_wind,
    CASE WHEN NOT no_weather THEN event_type IN ('error', 'signup', 'purchase') END AS wx_precip_flag,
    CAST(CASE WHEN no_weather THEN 0 ELSE 2 END AS BIGINT) AS nws_periods_written,
    CAST(CASE WHEN no_weather THEN 0 ELSE 2 - event_id % 3 END AS BIGINT) AS alerts_count, NOT no_incidents AS ga511_ok,
    CAST(CASE WHEN no_incidents OR shape = 4 THEN 0 WHEN shape = 1 THEN 2 ELSE 1 END AS BIGINT) AS ga511_events_count,
    concat_ws('; ', CASE WHEN no_weather THEN 'weather timeout' END, CASE WHEN no_incidents THEN 'HTTP 503: busy' END) AS errors
    FROM runs r"""
add("heartbeat", with_parts("runs") + _heartbeat)
add("stream_heartbeat", with_parts("runs") + _heartbeat)
add(
    "log_union",
    with_parts("incidents")
    + """SELECT CAST(event_id AS VARCHAR) AS id, lanes AS lanesBlocked, CAST(NULL AS VARCHAR) AS roadName FROM incidents
    UNION ALL SELECT CAST(event_id AS VARCHAR), NULL, 'I-75' FROM events WHERE event_type = 'click'""",
)
add(
    "log_append_scan",
    with_parts("incidents")
    + """SELECT epoch_us(ts) AS at_micros, CAST(event_id AS VARCHAR) AS id, lanes AS lanesBlocked,
        CAST(NULL AS VARCHAR) AS headline FROM incidents
    UNION ALL SELECT epoch_us(ts), NULL, NULL, CAST(event_id AS VARCHAR) FROM incidents""",
)
add(
    "retention",
    with_parts("incidents")
    + "SELECT CAST(event_id AS VARCHAR) AS id FROM incidents WHERE ts >= TIMESTAMP '2024-01-21'",
)
add("live_state_scores", _scored + "SELECT trip_id, round(p_final, 5) AS p_final, round(mph, 5) AS effective_mph FROM eta")
_accepted = f"""SELECT trip_id, request_ts, CASE kind WHEN 4 THEN 'US-1' ELSE road END AS road,
    CASE kind WHEN 4 THEN 45e0 ELSE freeflow END AS freeflow, CASE kind WHEN 4 THEN 1.2e0 ELSE path_factor END AS path_factor,
    CASE kind WHEN 4 THEN 33.5e0 ELSE olat END AS olat, CASE kind WHEN 4 THEN -84e0 ELSE olon END AS olon,
    CASE kind WHEN 4 THEN 34e0 ELSE dlat END AS dlat, CASE kind WHEN 4 THEN -84.5e0 ELSE dlon END AS dlon,
    CASE kind WHEN 4 THEN 0 ELSE leave_in END AS leave_in, kind <> 4 AND live AS live,
    CASE kind WHEN 4 THEN 'ors' ELSE 'auto' END AS router, true AS encoded_wanted
    FROM (SELECT *, CASE WHEN trip_id % 11 = 0 THEN 1 WHEN trip_id % 13 = 0 OR trip_id % 17 = 0 THEN 2
        WHEN trip_id % 19 = 0 THEN 4 ELSE 5 END AS kind FROM ({VIEWS['trips'][1]})) WHERE kind >= 4"""
add(
    "request_job",
    _scored.replace(VIEWS["trips"][1], _accepted).replace(VIEWS["stations"][1], f"SELECT * FROM ({VIEWS['stations'][1]}) WHERE lat >= 33.5")
    + """SELECT trip_id, CASE WHEN p_final IS NULL THEN 'unscored' ELSE 'result' END AS outcome, CAST(NULL AS VARCHAR) AS reason,
    CASE WHEN ok THEN provider ELSE 'fallback' END AS provider, round(p_final, 4) AS probability,
    CAST(format('{:.1f}', route_miles / mph * 60) AS DOUBLE) AS minutes, CAST(leave_in AS INTEGER) AS leave_in_minutes FROM eta
    UNION ALL SELECT o_orderkey, 'reject', CASE WHEN o_orderkey % 11 = 0 THEN 'Invalid or missing JSON body'
        ELSE 'Payload must include roadway, origin{lat,lon}, destination{lat,lon}' END, NULL, NULL, NULL, NULL
    FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0""",
)
add(
    "retention_during_ingest",
    with_parts("incidents")
    + """SELECT CAST(event_id AS VARCHAR) AS id FROM incidents
    WHERE event_id % 3 <> 1 OR ts >= TIMESTAMP '2024-01-21 12:00:00'""",
)
add(
    "stream_trip_scores",
    _scored
    + """SELECT trip_id, round(p_final, 4) AS probability, CASE WHEN live THEN round(p_time, 4) END AS before_live,
    round(mph, 2) AS effective_mph, CAST(format('{:.1f}', route_miles / mph * 60) AS DOUBLE) AS minutes,
    CASE WHEN ok THEN provider ELSE 'fallback' END AS provider FROM eta""",
)
