import os

from test_ingest import record, write

from airloom.operators import quality
from airloom.plans import analysis, report, validate
from airloom.sources import landed

PARAMETERS = [(1, "pm1", 3.0), (2, "pm25", 30.0), (4, "temperature", 20.0)]


def land(folder):
    for place in (6093549, 8, 3459):
        rows = [record(value=v + h + place % 7, pid=p, name=n, hour=h, place=place) for h in range(12) for p, n, v in PARAMETERS]
        write(folder, f"location_{place}.json", rows)
    write(folder, "location_9.json", "{broken")
    return f"{folder}/location_*.json"


def test_load_names_places_and_leaves_denied_ones_out(spark, folder):
    df = analysis.load(spark, land(folder))
    assert {(r.location_id, r.location_name) for r in df.select("location_id", "location_name").distinct().collect()} == {
        (6093549, "Golfutar"), (8, "Location 8"),
    }
    assert df.count() == 72 and df.select("seq").distinct().count() == 72
    row = df.where("datetime_utc = TIMESTAMP_NTZ '2025-12-05 01:00:00'").first()
    assert (str(row.date), row.hour, row.day_of_week) == ("2025-12-05", 6, "Friday")


def test_complete_analysis_writes_every_table(spark, folder):
    df = analysis.load(spark, land(folder))
    out = f"{folder}_out"
    written = analysis.write_analysis(df, analysis.known_names(spark), out, "2025-12-06 00:00:00")
    assert sorted(os.listdir(out)) == sorted(written)
    for name in set(written) - {"summary_statistics", "box_outliers"}:
        assert spark.read.parquet(f"{out}/{name}").count() > 0, name
    lines = [r.value for r in spark.read.text(f"{out}/summary_statistics").collect()]
    assert lines[1] == "AIR QUALITY DATA ANALYTICS SUMMARY" and lines[5] == "Total Records: 72"
    assert "PM25 (µg/m³):" in lines and "Golfutar (ID: 6093549):" in lines and "  Count:   24" in lines


def test_file_validation_reports_scores_and_unreadable_files(spark, folder):
    path = land(folder)
    write(folder, "location_7.json", [record(place=7), {"value": 1}])
    got = {os.path.basename(r.source_file): r for r in validate.file_metrics(spark, path, "2025-12-06 00:00:00").collect()}
    assert got["location_8.json"].quality_score == 100 and got["location_8.json"].error is None
    assert got["location_7.json"].quality_score == 50
    assert got["location_9.json"].error == "document is not JSON" and got["location_9.json"].quality_score is None
    assert validate.validated_files(spark, path, "2025-12-06 00:00:00", sample_size=10).count() == 10


def test_report_lists_records_of_files_in_their_order(spark, folder):
    write(folder, "location_7.json", [{"value": i} for i in range(12)])
    rows = validate.validated_files(spark, f"{folder}/location_*.json", "2025-12-06 00:00:00")
    lines = report.validation_report(quality.quality_metrics(rows), quality.first_errors(rows), "now").orderBy("line_no").collect()
    named = [int(r.text[7:-1]) for r in lines if r.text.startswith("Record ")]
    assert named == sorted(named) and [n % landed.POSITIONS for n in named] == list(range(10))
