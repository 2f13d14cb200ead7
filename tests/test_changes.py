"""A resource that grows, read as a stream and as a batch."""

import json
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from docweave.sources import changes


def server(folder):
    """Serves ``folder``/<name>.json by start and limit, filters by the hints, and notes each request."""

    def fetch(url):
        parts = urlsplit(url)
        asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
        results = json.loads((folder / f"{parts.path.strip('/')}.json").read_text())
        if "space" in asked:
            results = [r for r in results if r["space"]["key"] == asked["space"]]
        if "from_version" in asked:
            results = [r for r in results if r["version"]["number"] >= int(asked["from_version"])]
        with (folder / "log").open("a") as f:
            f.write(url + "\n")
        start = int(asked["start"])
        return {"results": results[start : start + int(asked["limit"])]}

    return fetch


def write(folder, name, n):
    rows = [{"id": f"{name}{i}", "version": {"number": i % 4}, "space": {"key": "AB"[i % 2]}} for i in range(n)]
    (folder / f"{name}.json").write_text(json.dumps(rows))


@pytest.fixture
def source(spark, tmp_path):
    write(tmp_path, "a", 23)
    write(tmp_path, "b", 4)
    spark.dataSource.register(changes.changes_source("docweave_changes", server(tmp_path)))
    return tmp_path


def options(reader, urls="a b"):
    return reader.format("docweave_changes").option("urls", urls).option("limit", 5).option("slice", 7).load()


def run(spark, folder, urls="a b"):
    q = options(spark.readStream, urls).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return sorted((r["url"], r["ord"], r["id"]) for r in spark.read.parquet(str(folder / "out")).collect())


def test_each_result_comes_once_over_restarts(spark, source):
    want = lambda a, b: sorted([("a", i, f"a{i}") for i in range(a)] + [("b", i, f"b{i}") for i in range(b)])
    assert run(spark, source) == want(23, 4)
    assert run(spark, source) == want(23, 4)
    write(source, "a", 40)
    write(source, "b", 5)
    assert run(spark, source) == want(40, 5)


def test_conditions_reach_the_resource_and_hold_anyway(spark, source):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = options(spark.read.option("hints", "true")).where("space = 'A' and version > 1").select("id")
        assert sorted(r["id"] for r in found.collect()) == sorted(f"{n}{i}" for n, k in (("a", 23), ("b", 4)) for i in range(k) if i % 2 == 0 and i % 4 > 1)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert "space=A&from_version=2" in (source / "log").read_text()
    assert options(spark.read).where("space = 'A' and version > 1").count() == 7
    assert options(spark.read).agg(F.count("*")).first()[0] == 27
