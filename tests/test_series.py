import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import prepare
from tidemark.functions.calendar import check_freq
from tidemark.operators import exog, future, series, split
from tidemark.operators.series import ITEM, TS, Y

D = dt.datetime


def make(spark, rows):
    return spark.createDataFrame(rows, "item_id string, timestamp timestamp_ntz, target double")


def values(df, c=Y):
    return [r[c] for r in df.orderBy(ITEM, TS).collect()]


def test_duplicate_times_stop_the_grid(spark):
    df = make(spark, [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 1), 2.0)])
    with pytest.raises(Exception, match="duplicate timestamp"):
        series.regular_grid(df, "D").collect()
    merged = series.merge_duplicates(df, [Y])
    assert values(merged) == [3.0]


def test_keys_find_the_time_among_them(spark):
    days = [f"{d:02d}/03/2024" for d in range(1, 25)]
    df = spark.createDataFrame([(t, f"s{i % 3}", i, float(i)) for i, t in enumerate(days)], "a string, b string, n int, v double")
    for keys in (["a", "b"], ["b", "a"]):
        got, roles = series.series_keys(df, keys)
        assert roles == {"time": "a", "item": "b"} and got.columns == [ITEM, TS, "n", "v"]
        assert [tuple(r) for r in got.orderBy("n").collect()] == [(f"s{i % 3}", D(2024, 3, i + 1), i, float(i)) for i in range(24)]
    both = df.withColumn("c", F.to_date("a", "dd/MM/yyyy"))
    assert series.series_keys(both, ["a", "c", "b"])[1] == {"time": "c", "item": "a"}  # the last of two times
    assert series.series_keys(both, ["c", "b"])[0].orderBy("n").first()[TS] == D(2024, 3, 1)
    lone, roles = series.series_keys(df, ["a"])
    assert roles == {"time": "a", "item": None} and {r[ITEM] for r in lone.collect()} == {"0"}
    with pytest.raises(ValueError, match="24 of 24 times in 'n'"):
        series.series_keys(df, ["b", "n"])  # none looks like a time: the last one is tried
    more = spark.createDataFrame([(f"2024-01-{i % 28 + 1:02d}" if i < 95 else None if i < 97 else "soon", "x")
                                  for i in range(100)], "t string, item string")
    with pytest.raises(ValueError, match="5 of 100 times in 't'"):  # 5 % is still the time, but its nulls are an error
        series.series_keys(more, ["t", "item"])
    with pytest.raises(ValueError, match="in 'item'"):
        series.series_keys(more.where("t IS NULL OR t <> '2024-01-01'"), ["t", "item"])
    assert series.series_keys(df.limit(0), ["b", "a"])[0].count() == 0
    with pytest.raises(ValueError, match="no keys"):
        series.series_keys(df, [])
    with pytest.raises(ValueError, match="names of the new keys"):
        series.series_keys(df.withColumn("Timestamp", F.lit(1)), ["a", "b"])
    with pytest.raises(ValueError, match="2 times"):
        series.require_times(spark.createDataFrame([(D(2024, 1, 1),), (None,), (None,)], "t timestamp_ntz"), "t")


def test_forward_fill_stops_at_the_cap(spark):
    df = make(spark, [("a", D(2024, 1, 1), 5.0), ("a", D(2024, 1, 6), 7.0)])
    assert values(series.regular_grid(df, "D")) == [5.0] * 5 + [7.0]
    assert values(series.regular_grid(df, "D", -1.0, 2)) == [5.0, 5.0, 5.0, -1.0, -1.0, 7.0]


def test_points_off_the_grid_are_dropped_and_leading_nulls_filled(spark):
    df = make(spark, [("a", D(2024, 1, 1), None), ("a", D(2024, 1, 1, 12), 9.0), ("a", D(2024, 1, 3), 4.0)])
    assert values(series.regular_grid(df, "D")) == [0.0, 0.0, 4.0]


def test_month_grid_keeps_month_ends(spark):
    df = make(spark, [("a", D(2024, 1, 31), 1.0), ("a", D(2024, 4, 30), 2.0)])
    out = series.as_freq(df, "M")
    assert [r[TS] for r in out.orderBy(TS).collect()] == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31), D(2024, 4, 30)]
    ahead = future.future_grid(df, 2, "M").orderBy("h").collect()
    assert [r[TS] for r in ahead] == [D(2024, 5, 31), D(2024, 6, 30)]


def test_frequency_names():
    assert check_freq("ME") == "M" and check_freq("W-SUN") == "W" and check_freq("h") == "H"
    with pytest.raises(ValueError):
        check_freq("Q")


def test_irregular_series_counts_as_daily(spark):
    weekly = [("a", D(2024, 1, 1) + dt.timedelta(days=7 * i + (1 if i == 3 else 0)), 1.0) for i in range(6)]
    assert series.lone_frequency(make(spark, weekly)) == "D"


def test_short_series_policies(spark):
    rows = [("long", D(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(5)]
    df = make(spark, rows + [("short", D(2024, 1, 1), 1.0)])
    parts = {p: split.tail_split(df, 2, p) for p in split.SHORT}
    assert parts["drop"].where("item_id = 'short'").count() == 0
    assert [r.part for r in parts["val"].where("item_id = 'short'").collect()] == ["val"]
    assert [r.part for r in parts["train"].where("item_id = 'short'").collect()] == ["train"]
    assert parts["drop"].where("part = 'val'").count() == 2
    with pytest.raises(ValueError):
        split.require_both_parts(split.tail_split(df.where("item_id = 'short'"), 2, "train"))


def test_future_covariates_of_flags_and_unknowns(spark):
    df = make(spark, [("a", D(2024, 1, i), 1.0) for i in (1, 2)]).withColumns({
        "promo": F.lit(1.0), "price": F.when(F.dayofmonth(TS) == 1, 3.5), "never": F.lit(None).cast("double")})
    row = future.future_exog(df, ["promo", "price", "never"], 1, "D").first()
    assert (row["promo"], row["price"], row["never"]) == (0.0, 3.5, 0.0)


def test_exog_cleaning(spark):
    df = make(spark, [("a", D(2024, 1, i), 1.0) for i in (1, 2, 3)]).withColumns({
        "x": F.when(F.dayofmonth(TS) == 2, float("inf")).otherwise(F.dayofmonth(TS).cast("double")),
        "word": F.when(F.dayofmonth(TS) == 3, "7").otherwise("bad"), "flat": F.lit(2.0)})
    out, kept = exog.clean_exog(df, ["x", "word", "flat"], add_calendar=False)
    assert kept == ["x", "word"]
    assert values(out, "x") == [1.0, 1.0, 3.0] and values(out, "word") == [0.0, 0.0, 7.0]


def test_required_covariates_stay_when_constant(spark):
    df = make(spark, [("a", D(2024, 1, i), 1.0) for i in (1, 2)]).withColumns({"flat": F.lit(2.0), "level": F.lit(1.0)})
    out, kept = exog.clean_exog(df, ["flat", "level"], add_calendar=False, required=("flat",))
    assert kept == ["flat"] and "level" not in out.columns and values(out, "flat") == [2.0, 2.0]


@pytest.mark.parametrize("lines", [
    [(1, "A"), (1, "A"), (1, "A")],  # first_line is constant
    [(1, "A"), (2, None), (None, "A"), (1, None)],  # null items have no rows in the join: level is not constant
])
def test_exog_clean_query_with_constants_and_nulls(spark, tmp_path, lines):
    rows = [(n, 0.01 * i, flag, "F", D(2024, 1, 1 + 2 * i)) for i, (n, flag) in enumerate(lines)]
    spark.createDataFrame([(*r, 1.0) for r in rows], "l_linenumber int, l_discount double, l_returnflag string, "
                          "l_linestatus string, l_shipdate timestamp_ntz, l_quantity double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    relation = con.execute(prepare.ORACLES["exog_clean"])
    names = [c[0] for c in relation.description]
    ours = prepare.QUERIES["exog_clean"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, ours), key=str) == sorted(relation.fetchall(), key=str)


def test_thinning_and_window(spark):
    df = make(spark, [("a", D(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(10)])
    assert values(series.thin(df, 3)) == [0.0, 3.0, 6.0, 9.0]
    assert values(series.recent_history(df, 2)) == [7.0, 8.0, 9.0]


def test_month_grids_keep_the_time_of_day(spark):
    ends = make(spark, [("a", D(2024, m, d, 5), float(m)) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30))])
    out = series.as_freq(ends, "M").orderBy(TS).collect()
    assert [(r[TS], r[Y]) for r in out] == [(D(2024, m, d, 5), float(m)) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30))]
    assert series.lone_frequency(ends) == "M"
    starts = make(spark, [("a", D(2024, m, 1, 7, 30), float(m)) for m in (1, 2, 4)])
    assert values(series.regular_grid(starts, "MS")) == [1.0, 2.0, 2.0, 4.0]


def test_month_grids_stay_inside_the_times(spark):
    df = make(spark, [("a", D(2024, 1, 15), 1.0), ("a", D(2024, 2, 1), 2.0), ("a", D(2024, 4, 10), 3.0)])
    assert [r[TS] for r in series.as_freq(df, "MS").orderBy(TS).collect()] == [D(2024, m, 1) for m in (2, 3, 4)]
    assert [r[TS] for r in series.as_freq(df, "M").orderBy(TS).collect()] == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31)]
    assert series.as_freq(make(spark, [("a", D(2024, 1, 2), 1.0)]), "MS").count() == 0
