"""Readers, options, pagination, streaming."""

import json

import pytest

from docweave.sources import files, rest, sinks
from docweave.streaming import incremental


def test_markdown_bytes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# x")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"no")
    found = {r["path"].rsplit("/", 1)[1]: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.md", "b.md"}
    assert (found["a.md"]["text"], found["a.md"]["bom"], found["a.md"]["valid"]) == ("# x", True, True)
    assert (found["b.md"]["text"], found["b.md"]["valid"]) == (None, False)


def test_state_versions(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": 5, "units": [{"id": "unit-0001"}]}))
    (tmp_path / "t.json").write_text(json.dumps({"schema_version": 4, "units": []}))
    assert [r["units"][0]["id"] for r in files.read_state(spark, str(tmp_path)).collect()] == ["unit-0001"]


def test_translation_map_is_strict(spark):
    d = spark.createDataFrame([(1, '{"a": "b"}'), (2, '{"a": 1}'), (3, "[]"), (4, None)], "id int, json string")
    found = {r["id"]: r["translations"] for r in files.translation_map(d).collect()}
    assert found == {1: {"a": "b"}, 2: None, 3: None, 4: None}


def test_options():
    assert files.options(None).max_block_chars == 16000
    assert files.options("config = {'timeout': 5, 'unknown': 1}").timeout == 5
    for bad in ("config = {'timeout': True}", "config = open('x')", "config = {}\nconfig = {}"):
        with pytest.raises(ValueError):
            files.options(bad)


def test_pagination_never_returns_a_part():
    with pytest.raises(rest.IncompleteResults):
        list(rest.collect_pages(lambda u: {"results": [1]} if "start=0" in u else {"results": None}, "u"))
    assert list(rest.collect_pages(lambda u: {"results": [1, 2]} if "start=0" in u else {"results": []}, "u")) == [1, 2]


def test_event_log_appends(spark, tmp_path):
    for i in range(2):
        sinks.append_events(spark.createDataFrame([(i,)], "n int"), str(tmp_path / "log"))
    assert sorted(r["n"] for r in files.read_events(spark, str(tmp_path / "log"), "n int").collect()) == [0, 1]


def test_streamed_decisions_keep_the_latest(spark, tmp_path):
    schema = "event_no int, event string, region_id string, decision string, status string"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for n, decision in ((1, "translate"), (2, "protect")):
        spark.createDataFrame([(n, "ambiguity_decision", "r", decision, "passed")], schema).write.mode("append").parquet(source)
        incremental.latest_decisions(incremental.stream(spark, source, schema), out, check).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{out}/v1").collect()] == [("r", "protect", 2)]


def test_windows_close_by_watermark(spark):
    d = spark.createDataFrame([("2024-01-01 00:01:00", "a")], "t string, event string").selectExpr("cast(t as timestamp) ts", "event")
    assert incremental.windowed_counts(d).first()["count"] == 1
