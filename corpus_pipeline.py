"""The corpus pipeline: language ID, near-duplicate removal, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and rereads it as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import langid, minhash, mixing, packing, pii
from docweave.llm.scratch import apart, materialise, table, together


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that are null, without a letter, or not in any language of the corpus. The rest keep all columns."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.reject_unknown(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.without_copies(docs, minhash.Params(words=5))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that disclose it, by their kind; n_chars follows the new text."""
    own = ("text", "n_chars")
    clean = pii.sanitise(pii.find(apart(docs, *own)))
    return together(clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs, *own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source gets its share of the words; a document comes twice at most."""
    own = ("doc_id", "text", "source")
    mixed = mixing.mix(apart(docs, *own)).where("copies > 0")
    return together(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, *own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all rows into sequences of 2048 tokens: one row per piece with its sequence and place."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: Language models, similarity groups and tokenisation have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
