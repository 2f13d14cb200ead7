"""Queries that go through bytes and files: Markdown bytes, states, logs, written tables, configuration."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import secrets
from ..sources import files, sinks
from ..sources.shared import shared_folder
from .catalog import expected, query, rows, table


_BYTES = "CASE doc_id % 3 WHEN 0 THEN '\\xEF\\xBB\\xBF'::BLOB || encode(text) WHEN 1 THEN encode(text) || '\\xFF'::BLOB ELSE encode(text) END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN text END AS text, doc_id % 3 = 0 AS bom, sha256({_BYTES}) AS sha256, doc_id % 3 <> 1 AS valid FROM documents WHERE text IS NOT NULL")
def markdown_bytes(spark, sf_dir):
    """Texts as bytes: a third begins with a byte order mark, a third ends in a byte that is no UTF-8."""
    content = F.encode("text", "UTF-8")
    kind = F.pmod("doc_id", F.lit(3))
    made = F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), content)).when(kind == 1, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    return files.decoded(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", made.alias("content"))).drop("content")


@query(expected("path string, units int, first string", [("b.md", 2, "unit-0001"), ("c.md", 0, None)]))
def state_files(spark, sf_dir):
    """States in one JSON file; that of an older schema is left out."""
    states = [
        {"schema_version": 4, "source": {"path": "a.md"}, "units": [{"id": "unit-0001"}]},
        {"schema_version": 5, "source": {"path": "b.md"}, "units": [{"id": "unit-0001", "kind": "text"}, {"id": "unit-0002"}]},
        {"schema_version": 5, "source": {"path": "c.md"}, "units": []},
    ]
    at = shared_folder(spark, "states")
    rows(spark, "value string", [(json.dumps(states, indent=1),)]).coalesce(1).write.text(at)
    return files.read_state(spark, at).select("source.path", F.size("units").alias("units"), F.try_element_at("units", F.lit(1))["id"].alias("first"))


@query(expected("id int, terms int, a string", [(1, 1, "b"), (2, None, None), (3, None, None), (4, None, None), (5, 0, None), (6, 2, 'x "y", {z}')]))
def translation_maps(spark, sf_dir):
    given = [(1, '{"a": "b"}'), (2, '{"a": 1}'), (3, "[]"), (4, None), (5, "{}"), (6, '{"a": "x \\"y\\", {z}", "c": ""}')]
    found = files.translation_map(rows(spark, "id int, json string", given))
    return found.select("id", F.when(F.col("translations").isNotNull(), F.size("translations")).alias("terms"), F.try_element_at("translations", F.lit("a")).alias("a"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def event_log(spark, sf_dir):
    """A log that is appended to twice holds every event once, as it was."""
    events = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    at = shared_folder(spark, "events")
    sinks.append_events(events.where("role = 'user'"), at)
    sinks.append_events(events.where("role <> 'user' or role is null"), at)
    return files.read_events(spark, at, "conv_id long, turn long, role string, text string")


@query("SELECT 'd/' || doc_id || '.md' AS path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def written_files(spark, sf_dir):
    """A second write replaces the first as a whole."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    at = shared_folder(spark, "files")
    sinks.write_files(docs.withColumn("content", F.lit("old")), at)
    sinks.write_files(docs, at)
    return spark.read.schema("path string, content string").parquet(at).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


_CONFIGS = [
    (1, None, {}, (30, 16000, "")),
    (2, "config = {'timeout': 5, 'unknown': 1}", {}, (5, 16000, "")),
    (3, "config = {'timeout': 5}", {"timeout": 7}, (7, 16000, "")),
    (4, "config = {'timeout': True}", {}, (None, None, "timeout must be int")),
    (5, "config = open('x')", {}, (None, None, "not a literal")),
    (6, "config = {}\nconfig = {}", {}, (None, None, "config must be assigned exactly once")),
    (7, "config = {1: 2}", {}, (None, None, "config must be a dictionary with string keys")),
]


@query(expected("id int, timeout int, max_block_chars int, error string", [(i, *found) for i, _, _, found in _CONFIGS]))
def config_options(spark, sf_dir):
    """Defaults, literal configurations and environment values; a configuration is read and never run."""

    def read(source, environment):
        try:
            o = files.options(source, environment=environment)
            return o.timeout, o.max_block_chars, ""
        except ValueError as e:
            return None, None, "not a literal" if "malformed" in str(e) else str(e)

    return rows(spark, "id int, timeout int, max_block_chars int, error string", [(i, *read(source, environment)) for i, source, environment, _ in _CONFIGS])


# Formats only: every value is a run of one letter or digit.
_TOKENS = [
    (1, "key: sk-" + "a" * 24 + " end", "openai", "sk-" + "a" * 24),
    (2, "xsk-" + "a" * 24, None, None),
    (3, "(ghp_" + "b" * 20 + ")", "github", "ghp_" + "b" * 20),
    (4, "AKIA" + "C" * 16, "aws", "AKIA" + "C" * 16),
    (5, "AKIA" + "C" * 15, None, None),
    (6, ".".join(("eyJ" + "d" * 5, "d" * 5, "d" * 5)), "jwt", ".".join(("eyJ" + "d" * 5, "d" * 5, "d" * 5))),
    (7, "bearer " + "e" * 20, "bearer", "bearer " + "e" * 20),
]


@query(expected("doc_id int, kind string, value string", [(i, kind, value) for i, _, kind, value in _TOKENS if kind]))
def known_token_formats(spark, sf_dir):
    return secrets.known_tokens(rows(spark, "doc_id int, text string", [(i, text) for i, text, _, _ in _TOKENS]))
