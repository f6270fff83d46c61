"""Text inputs: single files, packed ones, and both in one folder."""

from pathlib import Path

from findmark.plans import results
from findmark.sources import tables

LIST = '[{"text": "clot", "clinical_status": "abnormal"}, 7]'


def test_single_and_packed_texts(spark, tmp_path):
    folder = tmp_path / "series_uuid=d%2Fe+f"
    folder.mkdir()
    (tmp_path / "a.txt").write_text("  one\ntwo \n")
    (tmp_path / "b.json").write_text(" \n")
    (folder / "part-0.txt").write_text("three\n")
    rows = [("p/1", ' say "x"\n\tand\r\ny '), ("p2", ""), ("p3", None)]
    tables.pack(spark.createDataFrame(rows, "series_uuid string, value string"), str(tmp_path / "packed"))
    good, bad = tables.read_reports(spark, str(tmp_path), "gt")
    told = {r["series_uuid"]: r["text"] for r in good.collect()}
    assert told == {"a": "one\ntwo", "d/e+f": "three", "p/1": 'say "x"\n\tand\r\ny'}
    assert sorted(r["series_uuid"] for r in bad.collect()) == ["b", "p2", "p3"]
    found = {r["series_uuid"]: r["indication"] for r in tables.read_indications(spark, str(tmp_path)).collect()}
    assert found == told | {"b": "", "p2": "", "p3": ""}


def test_findings_of_single_and_packed_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text(LIST)
    (tmp_path / "b.json").write_text("[]")
    tables.pack(spark.createDataFrame([("c", LIST), ("d", "{}"), ("e", None)], "series_uuid string, value string"), str(tmp_path / "packed"))
    found, series, bad = tables.read_findings(spark, str(tmp_path), "gt")
    assert sorted((r["series_uuid"], r["finding_id"], r["text"]) for r in found.collect()) == [("a", "a_001", "clot"), ("c", "c_001", "clot")]
    assert sorted(r[0] for r in series.collect()) == ["a", "b", "c"]
    assert sorted(r["series_uuid"] for r in bad.collect()) == ["d", "e"]


def test_folder_of_single_files_alone(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    good, bad = tables.read_reports(spark, str(tmp_path), "pred")
    assert [tuple(r) for r in good.collect()] == [("a", "pred", "one")] and bad.count() == 0


def test_derived_inputs_are_not_a_file_for_each_series(spark):
    texts = spark.range(3000).selectExpr("CAST(id AS string) AS series_uuid", "'x' AS value").coalesce(2)
    folder = Path(results._files(texts, "few-files").removeprefix("file:"))
    assert sum(p.is_file() for p in folder.rglob("*")) < 10
