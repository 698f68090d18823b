"""Formats, appending and natural column order of flat tables."""

from smframe.sources import tables


def test_formats_match_the_start_of_names():
    assert [tables.format_of(c) for c in ("SamplingRate", "EarthquakeMagnitude", "EpicentralDistance", "H1Lowpass", "PGA", "f0")] == ["%.0f", "%.1f", "%.2f", "%.5f", "%.8E", "%.5f"]


def test_rows_are_appended_or_replaced(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.23456789, float("nan"), None)], "id string, PGA double, StationLatitude double, EpicentralDistance double")
    row = tables.formatted(d).first()
    assert tuple(row) == ("a", "1.23456789E+00", "nan", "nan")
    path = f"{tmp_path}/t"
    tables.write_csv(d, path)
    tables.write_csv(d, path)
    assert spark.read.option("header", "true").csv(path).count() == 2
    tables.write_csv(d, path, append=False)
    assert spark.read.option("header", "true").csv(path).first()["PGA"] == "1.23456789E+00"


def test_natural_order_and_pivot(spark):
    names = ["SA(10.0)", "PGV", "SA(2.0)", "PGA"]
    assert tables.natural_order([*names, "id"], ["id"]) == ["id", "PGA", "PGV", "SA(2.0)", "SA(10.0)"]
    long = spark.createDataFrame([(1, "PGA", 2.0), (1, "SA(10.0)", 3.0), (2, "PGV", 1.0)], "id long, imt string, v double")
    wide = tables.metric_table(long, ["id"], "imt", "v", names)
    assert wide.columns == ["id", "PGA", "PGV", "SA(2.0)", "SA(10.0)"]
    assert {r.id: r["SA(10.0)"] for r in wide.collect()} == {1: 3.0, 2: None}


def test_readme(spark):
    assert tables.readme(spark, {"PGA": "peak"}).columns == ["Column header", "Description"]
