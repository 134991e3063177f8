"""Reports of nothing, of a null key, and of halves."""

from pyspark.sql import functions as F

from cadenza.operators import reports


def test_reports_of_nothing(spark):
    frames = spark.createDataFrame([], "k string, i long, on boolean, level double")
    segments = spark.createDataFrame([], "k string, start_s double, end_s double")
    assert reports.activity_report(frames, segments, ["k"], "i", "on", "level", 1.0, 10).count() == 0
    flags = spark.createDataFrame([], "k string, start_s double, end_s double, scenario string, kind string, confidence double, severity string")
    assert reports.flag_report(flags, ["k"]).count() == 0


def test_a_null_key_has_its_report(spark):
    frames = spark.createDataFrame([(None, i, 2 <= i < 5, 0.1) for i in range(8)] + [("quiet", 0, False, 0.0)], "k string, i long, on boolean, level double")
    segments = spark.createDataFrame([(None, 1.0, 2.5)], "k string, start_s double, end_s double")
    found = reports.activity_report(frames, segments, ["k"], "i", "on", "level", 0.5, 4)
    lines = [r["text"] for r in found.where("k is null").orderBy("section", "line").collect()]
    assert lines == [
        "duration 4.00 s", "speech 1.50 s (37.5 %)", "silence 2.50 s (62.5 %)", "segments 1", "   1      1.00 s      2.50 s      1.50 s",
        "     0.00 s SILENCE   0.10000", "     1.00 s SPEECH    0.10000", "     2.50 s SILENCE   0.10000", "    0     50 %   0.10000 ##########..........", "    1     25 %   0.10000 #####...............",
    ]
    assert [r["text"] for r in found.where("k = 'quiet' and section = 1").orderBy("line").collect()] == ["duration 0.50 s", "speech 0.00 s (0.0 %)", "silence 0.50 s (50.0 %)", "segments 0"]


def test_halves_go_up(spark):
    row = spark.range(1).select(reports.text("%.0f %.3f", reports.number(F.lit(12.5)), reports.number(F.lit(0.0625))).alias("t")).first()
    assert row["t"] == "13 0.063"
