"""Rows that would end a job, each beside one that is fine, and sources that would never end."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import documents, pages, wiki
from docweave.operators.rows import flat_map
from docweave.sources import rest, sinks

GOOD = "# Title\n\nA line with *words*.\n"


@pytest.mark.parametrize("n", [900, 3000])
def test_deeply_nested_texts(spark, n):
    texts = ["[" * n + "x" + "]" * n, "> " * n + "x", "*" * n + "x" + "*" * n, GOOD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    assert {r["doc_id"] for r in documents.extracted(df).select("doc_id").collect()} >= {0, 3}
    found = {r["doc_id"]: r for r in documents.rendered(df).collect()}
    assert set(found) == {0, 1, 2, 3} and found[3]["sha256"] == found[3]["source_sha256"]


@pytest.mark.parametrize("n", [1200, 5000])
def test_deeply_nested_pages(spark, n):
    good = "<html><body><article><h1>T</h1><p>text</p></article></body></html>"
    html = ["<div>" * n + "x" + "</div>" * n, "<ul><li>" * (n // 2) + "x", "<b>" * n, good]
    df = spark.createDataFrame([(i, f"https://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(1)
    found = {r["page_id"]: r["markdown"] for r in pages.markdown(df).select("page_id", "markdown").collect()}
    assert set(found) == {0, 1, 2, 3} and "text" in found[3]


def test_deeply_nested_storage(spark):
    texts = ["> " * 1500 + "x", "<div>" * 1500, "fine"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, markdown string").repartition(1)
    assert {r["id"] for r in wiki.to_storage(df).collect()} == {0, 1, 2}


def test_a_row_beyond_all_depths_costs_itself_alone(spark):
    def deep(key, n):
        def down(k):
            return 0 if k == 0 else 1 + down(k - 1)

        return [{"key": key, "n": down(n)}]

    df = spark.createDataFrame([(1, 10), (2, 10_000_000), (3, 20)], "key long, n long").repartition(1)
    found = {r["key"]: (r["n"], r["error"]) for r in flat_map(df, ["key", "n"], deep, "key long, n long, error string").collect()}
    assert found[1] == (10, None) and found[3] == (20, None) and found[2][1].startswith("RecursionError")


def test_a_link_back_is_refused():
    served = {"u?start=0&limit=2": {"results": [1], "_links": {"next": "b"}}, "b": {"results": [2], "_links": {"next": "c"}}, "c": {"results": [3], "_links": {"next": "b"}}}
    with pytest.raises(rest.IncompleteResults):
        list(rest.collect_pages(served.__getitem__, "u", 2))


def test_the_last_state_of_a_page_is_exported(spark):
    df = spark.createDataFrame([("1", "Old", "2024-01-01", "a"), ("1", "New", "2024-02-01", "b"), ("2", "Other", "2024-01-01", "c")], "page_id string, title string, when string, markdown string")
    found = sorted(r["content"] for r in sinks.export_files(df).collect())
    assert len(found) == 2 and any(x.endswith("b") for x in found) and not any("Old" in x for x in found)
    assert sinks.export_files(df.where(F.lit(False))).collect() == []
