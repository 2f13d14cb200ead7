"""The registered queries against their oracles, and the pipeline stage by stage against brute force."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import queries

from .test_operators import DOC, LONG, base_spans, brute_documents, brute_targets

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_oracle(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    result = c.execute(queries.ORACLES[name])
    assert canonical(found.collect(), found.columns) == canonical(result.fetchall(), [d[0] for d in result.description])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_row(spark, sf, name):
    table, key = ("pages", "page_id") if name.startswith("op6") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}
    found = [r[key] for r in queries.QUERIES[name](spark, sf).collect()]
    assert set(found) == ids and (name.startswith("op8") or len(found) == len(ids))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "x", None), (90002, "", None, None, 0), (90003, LONG, "en", None, len(LONG)), (90004, "12 !!", "en", "x", 5), (90005, "write to a@b.example now please", "en", "x", 31), (None, "the of and to in is", "en", "x", 19)], DOC)
    docs = docs.select(*DOCUMENTS).unionByName(odd).cache()
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, docs, sf).cache()
    assert known.columns == DOCUMENTS
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in known.collect()}
    assert {90001, 90002, 90004} <= gone and len(gone) <= 6
    single = stage["near_duplicates"](spark, known, sf).cache()
    _, component = brute_documents([(r["doc_id"], r["text"]) for r in known.collect() if r["doc_id"] is not None], 5)
    assert {r["doc_id"] for r in single.collect() if r["doc_id"] is not None} == set(component.values())
    clean = stage["personal_data"](spark, single, sf).cache()
    assert clean.columns == DOCUMENTS and clean.count() == single.count()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
        if not base_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert all(not any(s.startswith("email") for s in base_spans(r["text"])) for r in clean.collect())
    mixed = stage["mix"](spark, clean, sf).cache()
    assert mixed.columns == DOCUMENTS
    sizes, taken = collections.Counter(), collections.Counter()
    for r in clean.collect():
        sizes[r["source"]] += len(r["text"].split())
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    want = brute_targets(sizes)
    # The one very long document comes whole or not at all.
    assert abs(sum(taken.values()) - sum(want.values())) <= 0.05 * sum(want.values()) + len(LONG.split()) / 2
    assert max(collections.Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    packed = stage["pack"](spark, mixed, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_keep_columns_of_any_name_and_rows_of_repeated_ids(spark, sf):
    names = ["score", "lang_pred", "bits_per_byte", "key", "group", "kept", "pii_email", "size", "target", "mean", "moves", "multiplier", "copies"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*DOCUMENTS).limit(60)
    text = "one two three four five six seven eight nine ten the house and the garden were there"
    again = spark.createDataFrame([(80001, text, "en", "x", 1), (80001, text, "en", "x", 1), (80001, text + " now", "en", "x", 1), (80002, text, "en", "x", 1)], DOC)
    docs = docs.unionByName(again).withColumns({n: F.lit(7.5) for n in names}).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.where(" or ".join(f"{n} is null or {n} <> 7.5" for n in names)).count() == 0, name
        if name == "near_duplicates":
            assert [r["text"] for r in out.where("doc_id in (80001, 80002)").collect()] in ([text], [text + " now"])
        assert stage(spark, docs.limit(0), sf).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
