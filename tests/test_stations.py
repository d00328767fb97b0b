import numpy as np
import pytest
from pyspark.sql import functions as F

from tripflow.operators import stations as st
from tripflow.operators.joins import null_safe_join


def wide(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


@pytest.fixture(scope="module")
def tables(spark):
    old = wide(
        spark,
        [("1", "A", "10", "1"), ("2", None, "20", "2"), ("3", "B", "x", None)],
        ["Station ID", "Functional Class", "AADT 2014", "TruckPct 2014"],
    )
    new = wide(
        spark,
        [
            ("1", "A", "12", "14", "3", "33.0", "-84.0"),
            ("2", None, None, "26", "4", "33.1", "-84.1"),
            ("4", "C", None, None, "NaN", None, "-84.2"),
            ("1", "Z", "5", None, None, "33.3", "-84.3"),
        ],
        ["Station ID", "Functional Class", "AADT 2016", "AADT 2018", "Truck 2018", "Latitude", "Long"],
    )
    annual = wide(
        spark,
        [("1", ".1", ".5", "T"), ("1", ".1", ".5", "T"), ("1", ".2", ".5", "T"), ("9", ".3", ".5", "T")],
        ["Station ID", "KFactor", "DFactor", "Station Type"],
    )
    return old, new, annual


def test_join_matches_nulls_and_fans_out(spark, tables):
    rows = st.merge_stations(*tables)
    keys = sorted((r["STATION_ID"], r["FUNCTIONAL_CLASS"] or "-", r["KFACTOR"] or "-") for r in rows.collect())
    assert keys == [("1", "A", "0.1"), ("1", "A", "0.2"), ("1", "Z", "0.1"), ("1", "Z", "0.2"), ("2", "-", "-"), ("3", "B", "-"), ("4", "C", "-")]
    two = rows.where("STATION_ID = '2'").first()
    assert (two["AADT_2014"], two["AADT_2018"]) == ("20", "26")


def test_hot_key_join_multiplies_like_any_join(spark):
    left = spark.createDataFrame([(None, i) for i in range(5)] + [("a", 9)], "k string, l int")
    right = spark.createDataFrame([(None, i) for i in range(4)] + [("b", 9)], "k string, r int")
    assert null_safe_join(left, right, ["k"], "full").count() == 22
    assert null_safe_join(left, right, ["k"], "left").count() == 21


@pytest.mark.parametrize("crowded", [1, 7, 100_000])
@pytest.mark.parametrize("how", ["left", "full"])
def test_join_equals_spark_join_however_keys_are_dealt(spark, crowded, how):
    # one key holds half the rows of each side; others are on one side only
    left = spark.createDataFrame([(None if i % 5 == 0 else "h" if i % 2 else f"l{i % 9}", i) for i in range(120)], "k string, x int")
    right = spark.createDataFrame([("h" if i % 2 else None if i % 7 == 0 else f"r{i % 6}", i) for i in range(60)], "k string, x int")
    right = right.union(spark.createDataFrame([("only", i) for i in range(20)], "k string, x int"))
    got = null_safe_join(left, right, ["k"], how, crowded=crowded)
    a, b = left.toDF("k", "x_OLD"), right.toDF("k2", "x_NEW")
    want = a.join(b, a.k.eqNullSafe(b.k2), how).select(F.coalesce("k", "k2").alias("k"), "x_OLD", "x_NEW")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_join_reads_each_side_once_and_spreads_a_crowded_key(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    sides = []
    for n in (1000, 10):
        rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias(f"v{n}"))
        sides.append(rows.mapInArrow(counted, rows.schema))
    joined = null_safe_join(*sides, ["k"], "full", crowded=50)
    assert joined.count() == 500 * 5 + 495 + 5 and read.value == 1010
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = joined.select("k", "v1000").where("k = 'hot'").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


def test_keys_are_compared_as_what_they_hold(spark):
    def joined(left, right):
        a, b = wide(spark, [(x, "l") for x in left], ["K", "L"]), wide(spark, [(x, "r") for x in right], ["K", "R"])
        return sorted(((r["K"], r["L"], r["R"]) for r in null_safe_join(a, b, ["K"], "full", typed=True).collect()), key=str)

    assert joined(["007", "-0", "NA"], ["7", " 0 ", ""]) == [("0", "l", "r"), ("7", "l", "r"), (None, "l", "r")]
    assert joined([".1", "7"], ["0.10", "7.0"]) == [("0.1", "l", "r"), ("7.0", "l", "r")]
    # one word among them makes all of them text
    assert joined(["007", "A"], ["7", "A"]) == [("007", "l", None), ("7", None, "r"), ("A", "l", "r")]
    assert joined(["99999999999999999999"], ["099999999999999999999"]) == [("99999999999999999999", "l", "r")]
    assert joined(["NaN", None], ["null"]) == [(None, "l", "r"), (None, "l", "r")]


def test_report_names_years_of_both_tables(spark):
    left = wide(spark, [("1", "A", "5", "7")], ["STATION_ID", "FUNCTIONAL_CLASS", "AADT_2015", "AADT_2014"])
    right = wide(spark, [("1", "A", "6")], ["STATION_ID", "FUNCTIONAL_CLASS", "AADT_2015"])
    annual = wide(spark, [("1", ".1", "0.5", "T"), ("01", "0.10", ".5", "T")], ["STATION_ID", "KFACTOR", "DFACTOR", "STATION_TYPE"])
    merged = st.merge_stations(left, right, annual)
    assert st.merge_report(merged) == {"years": [2014], "lost_years": [2015]} and merged.count() == 1


def test_year_in_both_tables_is_suffixed_and_lost(spark):
    left = wide(spark, [("1", "A", "5", "7")], ["STATION_ID", "FUNCTIONAL_CLASS", "AADT_2015", "AADT_2014"])
    right = wide(spark, [("1", "A", "6")], ["STATION_ID", "FUNCTIONAL_CLASS", "AADT_2015"])
    joined = null_safe_join(left, right, st.STATION_KEYS, "full")
    assert {"AADT_2015_OLD", "AADT_2015_NEW", "AADT_2014"} <= set(joined.columns)
    assert st.volume_years(joined.columns) == [2014]


def test_features(spark, tables):
    rows = {(r["STATION_ID"], r["FUNCTIONAL_CLASS"], r["KFACTOR"]): r for r in st.station_table(*tables).collect()}
    one = rows[("1", "A", 0.1)]
    assert one["AADT_TREND_SLOPE"] == pytest.approx(np.polyfit([2014, 2016, 2018], [10, 12, 14], 1)[0])
    assert one["AADT_MEAN_3YR"] == pytest.approx(12) and one["AADT_STD_3YR"] == pytest.approx(np.std([10, 12, 14]))
    assert (one["AADT_LATEST"], one["TRUCK_PCT_LATEST"], one["TRUCK_PCT_MEAN"]) == (14.0, 3.0, 2.0)
    single = rows[("1", "Z", 0.1)]
    assert single["AADT_TREND_SLOPE"] is None and single["AADT_STD_3YR"] == 0.0
    none = rows[("4", "C", None)]
    assert none["AADT_MEAN_3YR"] is None and none["AADT_STD_3YR"] is None and none["TRUCK_PCT_LATEST"] is None
    assert rows[("3", "B", None)]["AADT_MEAN_3YR"] is None


def test_located_is_for_serving_only(spark, tables):
    table = st.station_table(*tables)
    assert table.count() == 7 and st.located(table).count() == 5


def test_windows_use_present_columns(spark):
    years = [2001, 2003, 2007, 2008, 2012, 2013, 2019]
    table = wide(spark, [tuple(["1"] + [str(y % 7) for y in years] + ["1", "2"])], ["STATION_ID"] + [f"AADT_{y}" for y in years] + ["LAT", "LON"])
    row = st.yearly_features(st.typed_stations(table)).first()
    assert row["AADT_TREND_SLOPE"] == pytest.approx(np.polyfit(years[-6:], [y % 7 for y in years[-6:]], 1)[0])
    assert row["AADT_MEAN_3YR"] == pytest.approx(np.mean([y % 7 for y in years[-3:]]))


def test_latitude_preference(spark):
    table = wide(spark, [("1", "2", "3", "4")], ["LAT", "LATITUDE", "LON", "AADT_2000"])
    assert st.typed_stations(table, "serving").first()["LAT"] == 1.0
    assert st.typed_stations(table, "training").first()["LAT"] == 2.0
    with pytest.raises(ValueError):
        st.typed_stations(table.drop("LON"))


def test_contract_adds_missing_columns(spark):
    row = st.feature_contract(spark.createDataFrame([(1.0, "x")], "LAT double, other string")).first()
    assert len(row) == 11 and row["LAT"] == 1.0 and row["STATION_TYPE"] is None


def test_no_shuffle_after_the_merge(spark, tables):
    table = wide(spark, [("1", "2", "3", "4")], ["LAT", "LATITUDE", "LON", "AADT_2000"])
    plan = st.yearly_features(st.typed_stations(table))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
