"""Queries over documents and conversations: lines, units, blocks, contracts, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import blocks, documents, gates, lines, report, secrets, state
from ..sources.shared import shared_folder
from ..streaming import incremental, keyed
from . import scanner_sql as S
from .catalog import query, table

_LINES = """l0 AS (
  SELECT doc_id, generate_subscripts(x, 1) AS number, unnest(x) AS content, len(x) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), l AS (
  SELECT doc_id, number, content, CASE WHEN number < n THEN 1 ELSE 0 END AS nl,
    coalesce(sum(length(content) + CASE WHEN number < n THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM l0 WHERE content <> '' OR number < n OR number = 1
)"""
_UNITS = (
    _LINES
    + """, u AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY number) AS INTEGER) AS unit, number, start, content AS source, length(content) AS chars
  FROM l WHERE regexp_matches(content, '[A-Za-z]')
)"""
)
_HEADING = "content <> '' AND NOT regexp_matches(content, '^[^ ]+ [^ ]+ [^ ]+ ')"


def _is_heading():
    return (F.col("content") != "") & ~F.col("content").rlike("^[^ ]+ [^ ]+ [^ ]+ ")


def _lines(spark, sf_dir) -> DataFrame:
    return lines.explode_lines(table(spark, sf_dir, "documents"))


def _units(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir).where(F.col("content").rlike("[A-Za-z]"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("number"))
    return rows.select("doc_id", n.alias("unit"), "number", "start", F.col("content").alias("source"), F.length("content").alias("chars"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(number AS INTEGER) AS number, CAST(start AS BIGINT) AS start, CAST(start + length(content) AS BIGINT) AS content_end, CAST(start + length(content) + nl AS BIGINT) AS \"end\", content FROM l")
def doc_lines(spark, sf_dir):
    return _lines(spark, sf_dir).drop("newline")


@query(
    f"""WITH {_LINES}, m AS (
      SELECT *, regexp_replace(content, '^[ \\t\\r\\n\\f\\v]+|[ \\t\\r\\n\\f\\v]+$', '', 'g') AS s FROM l
    ), p AS (SELECT *, starts_with(s, '$$') AS mark, sum(CASE WHEN starts_with(s, '$$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY number) - CASE WHEN starts_with(s, '$$') THEN 1 ELSE 0 END AS before FROM m),
    q AS (SELECT *, mark OR s = '' OR regexp_matches(s, '^(#|>|!\\[|[-*+] )') AS brk FROM p WHERE mark OR before % 2 = 0),
    r AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY number) AS island FROM q WHERE mark OR brk OR NOT regexp_matches(content, '^ \\s*\\s\\S')),
    g AS (SELECT doc_id, island, count(*) AS n, max(length(content)) AS longest FROM r WHERE NOT brk GROUP BY ALL)
    SELECT doc_id, CAST(sum(CASE WHEN n >= 2 AND longest < 80 THEN 1 ELSE 0 END) AS BIGINT) AS chopped, count(*) AS total, 2 * sum(CASE WHEN n >= 2 AND longest < 80 THEN 1 ELSE 0 END) >= count(*) AS suggest_merge FROM g GROUP BY doc_id"""
)
def doc_paragraph_stats(spark, sf_dir):
    return lines.paragraph_stats(_lines(spark, sf_dir)).withColumn("suggest_merge", 2 * F.col("chopped") >= F.col("total"))


@query(
    f"""WITH {_LINES}, h AS (SELECT *, {_HEADING} AS head FROM l)
    SELECT doc_id, CAST(number AS INTEGER) AS number, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS BIGINT) AS section_no,
      coalesce(last_value(CASE WHEN head AND trim(content, ' ') <> '' THEN trim(content, ' ') END IGNORE NULLS) OVER w, '') AS section
    FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def doc_sections(spark, sf_dir):
    return lines.sections(_lines(spark, sf_dir), _is_heading()).select("doc_id", "number", "section_no", "section")


@query(f"WITH {_UNITS} SELECT doc_id, unit, CAST(start AS BIGINT) AS start, source, CAST(chars AS INTEGER) AS chars FROM u")
def doc_units(spark, sf_dir):
    return _units(spark, sf_dir).select("doc_id", "unit", "start", "source", "chars")


@query(f"WITH {_UNITS} SELECT doc_id, unit, coalesce(lag(source) OVER w, '') AS context_before, coalesce(lead(source) OVER w, '') AS context_after FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY start)")
def unit_context(spark, sf_dir):
    return blocks.context(_units(spark, sf_dir), "doc_id", "start", "source").select("doc_id", "unit", "context_before", "context_after")


_PACKED = f"""WITH RECURSIVE {_UNITS}, p AS (
  SELECT doc_id, unit, chars, source, 1 AS block, chars AS used FROM u WHERE unit = 1
  UNION ALL
  SELECT u.doc_id, u.unit, u.chars, u.source, CASE WHEN p.used + u.chars > 600 THEN p.block + 1 ELSE p.block END, CASE WHEN p.used + u.chars > 600 THEN u.chars ELSE p.used + u.chars END
  FROM p JOIN u ON u.doc_id = p.doc_id AND u.unit = p.unit + 1
)"""


def _packed(spark, sf_dir) -> DataFrame:
    return blocks.pack(_units(spark, sf_dir), 600, ["doc_id"])


@query(f"{_PACKED} SELECT doc_id, CAST(block AS INTEGER) AS block, count(*) AS unit_count, min(unit) AS first_unit, max(unit) AS last_unit, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(strlen(source)) AS BIGINT) AS bytes FROM p GROUP BY doc_id, block")
def doc_blocks(spark, sf_dir):
    return blocks.block_totals(_packed(spark, sf_dir), ["doc_id"])


@query(f"{_PACKED} SELECT doc_id, sha256(string_agg(block || ':' || unit || ':' || sha256(source), chr(10) ORDER BY unit)) AS fingerprint FROM p GROUP BY doc_id")
def plan_fingerprint(spark, sf_dir):
    return blocks.fingerprint(_packed(spark, sf_dir), ["doc_id"])


@query(
    f"""WITH {_UNITS}, h AS (SELECT doc_id, start, CASE WHEN number % 2 = 0 THEN 4 ELSE 1 END AS level FROM l WHERE {_HEADING}), k AS (SELECT * FROM h WHERE level <= 3),
    o AS (SELECT u.doc_id, u.chars, k.start AS s FROM u ASOF LEFT JOIN k ON u.doc_id = k.doc_id AND u.start >= k.start)
    SELECT doc_id, CAST(coalesce(s, -1) AS BIGINT) AS section_start, CAST(sum(chars) AS BIGINT) AS chars, count(*) AS units FROM o GROUP BY ALL"""
)
def section_chars(spark, sf_dir):
    heads = _lines(spark, sf_dir).where(_is_heading()).select("doc_id", "start", F.when(F.col("number") % 2 == 0, 4).otherwise(1).alias("level"))
    return blocks.section_chars(_units(spark, sf_dir), heads)


_CHANGED = "CASE doc_id % 4 WHEN 0 THEN text || ' **x** |' WHEN 1 THEN replace(text, '*', '') WHEN 2 THEN text || '$ [y](z)' ELSE text || '{{' END"


@query(
    f"""WITH d AS (SELECT doc_id, text AS b, {_CHANGED} AS a FROM documents),
    s AS (SELECT doc_id, t.x AS sign, t.i, (length(a) - length(replace(a, t.x, ''))) // length(t.x) AS na, (length(b) - length(replace(b, t.x, ''))) // length(t.x) AS nb
      FROM d, (VALUES ('`', 1), ('*', 2), ('_', 3), ('[', 4), (']', 5), ('<', 6), ('>', 7), ('|', 8), (chr(92), 9), ('$', 10), ('~~', 11), ('{{{{', 12), ('}}}}', 13)) AS t(x, i))
    SELECT doc_id, string_agg(sign, ' ' ORDER BY i) AS broken FROM s WHERE na > nb GROUP BY doc_id""".replace("{{{{", "{{").replace("}}}}", "}}")
)
def contract_syntax(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("before"), F.expr(_CHANGED).alias("after"))
    return gates.introduced_syntax(d).where(F.size("broken") > 0).select("doc_id", F.array_join("broken", " ").alias("broken"))


@query(
    """WITH g AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id)
    SELECT coalesce(d.doc_id, g.doc_id) AS doc_id, coalesce(g.n, 0) AS n, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN g.n IS NULL THEN 'missing' ELSE 'duplicate' END AS state
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN g ON g.doc_id = d.doc_id WHERE d.doc_id IS NULL OR g.n IS NULL OR g.n > 1"""
)
def contract_coverage(spark, sf_dir):
    given = table(spark, sf_dir, "labels")
    return gates.coverage(table(spark, sf_dir, "documents"), given.select("doc_id").unionAll(given.where("quality = 1").select("doc_id")), ["doc_id"])


@query(
    """WITH m AS (SELECT lang, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM m)
    SELECT lang, count(*) AS n, string_agg(CASE WHEN k <= 10 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id) AS first FROM r GROUP BY lang"""
)
def first_missing(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id")
    errors = table(spark, sf_dir, "documents").where("lang is not null").join(labels, "doc_id", "left_anti").select("lang", "doc_id")
    return gates.first_errors(errors, "lang", "doc_id").withColumn("first", F.array_join("first", ","))


@query("SELECT doc_id, sha256(text) AS sha256, true AS same FROM documents WHERE text IS NOT NULL")
def deterministic_render_identity(spark, sf_dir):
    return documents.rendered(table(spark, sf_dir, "documents").where("text is not null")).select("doc_id", "sha256", (F.col("sha256") == F.col("source_sha256")).alias("same"))


@query("SELECT doc_id, CASE WHEN length(text) >= 10 THEN 'XYZ' || substr(text, 4, 5) || '' || substr(text, 11) END AS rendered, coalesce(length(text), 0) >= 10 AS valid FROM documents")
def spliced_edits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edits = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(8).alias("start"), F.lit(10).alias("end"), F.lit("").alias("value")), F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("XYZ").alias("value")))).alias("e")).select("doc_id", "e.*")
    return blocks.spliced(docs, edits)


_SECRETS = rf"""
    -- Every sign of assignment for itself: what stands before it is cut into parts and compared with words, what follows is read as a value.
    WITH p AS (SELECT doc_id, text, generate_subscripts(g, 1) AS i, unnest(g) AS part FROM (SELECT doc_id, text, regexp_split_to_array(text, '[:=]') AS g FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT doc_id, part, substr(text, CAST(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) + 1 AS BIGINT)) AS rest, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS more FROM p),
    n AS (SELECT doc_id, lower(regexp_extract(rtrim(rtrim(part, ' ' || chr(9)), '"' || chr(39)), '[A-Za-z0-9_-]+$')) AS name, ltrim(rest, ' ' || chr(9)) AS rest FROM s WHERE more IS NOT NULL),
    w AS (SELECT *, string_split(replace(name, '-', '_'), '_') AS words FROM n),
    f AS (SELECT * FROM w WHERE len(list_intersect(words, ['token', 'secret', 'password', 'passwd', 'apikey'])) > 0 OR contains('_' || array_to_string(words, '_') || '_', '_api_key_')),
    v AS (SELECT doc_id, name, CASE WHEN starts_with(rest, '"') THEN string_split(rest, '"')[2] WHEN starts_with(rest, chr(39)) THEN string_split(rest, chr(39))[2] ELSE regexp_extract(rest, '^[^ \t\r\n\f\v,;#`"'']+') END AS value FROM f)
    SELECT doc_id, name, value FROM v WHERE trim(value) <> '' AND NOT (starts_with(value, '<') AND ends_with(value, '>')) AND NOT contains(value, '${{') AND NOT regexp_matches(lower(value), 'placeholder|your[-_]|example|fixture|(test|env|file|sample)-token|^no-?check$')
"""


@query(_SECRETS)
def secret_scan(spark, sf_dir):
    return secrets.assignments(table(spark, sf_dir, "documents"))


@query(S.KNOWN_TOKENS)
def known_token_scan(spark, sf_dir):
    return secrets.known_tokens(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, CAST(length(text) AS INTEGER) AS chars, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' ELSE 'lf' END AS ending, length(x) - length(replace(x, '$', '')) AS dollars FROM (SELECT *, regexp_replace(text, '(?s)\\\\.', '', 'g') AS x FROM documents)")
def doc_scalars(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", C.sha256(t).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), C.translatable_chars(t).alias("chars"), F.when(C.line_ending(t) == "\r\n", "crlf").otherwise("lf").alias("ending"), C.unescaped_count(t, r"\$").cast("long").alias("dollars"))


@query("SELECT doc_id, t.x AS sign, CAST(length(text) - length(replace(text, t.x, '')) AS BIGINT) AS n FROM documents, (VALUES ('*'), ('|'), ('$'), ('_')) AS t(x) WHERE contains(text, t.x)")
def syntax_histogram(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit(r"[*|$_]"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("sign")).groupBy("doc_id", "sign").agg(F.count("*").alias("n"))


@query()
def doc_units_scan(spark, sf_dir):
    found = documents.extracted(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "error", F.explode("units").alias("u")).select("doc_id", "error", "u.id", "u.kind", "u.start", "u.end", "u.line_start", "u.line_end", "u.template", "u.section", "u.chars")


@query()
def doc_blocks_scan(spark, sf_dir):
    return documents.planned(table(spark, sf_dir, "documents"), 2000)


@query(S.DOC_FORMULAS)
def doc_formulas(spark, sf_dir):
    return documents.formulas(table(spark, sf_dir, "documents"))


@query(S.DOC_REPAIRS)
def doc_repairs(spark, sf_dir):
    r = documents.repaired(table(spark, sf_dir, "documents"))
    return r.select("doc_id", C.sha256(F.col("unescaped")).alias("unescaped"), C.sha256(F.col("promoted")).alias("promoted"), F.size("promotions").alias("promotions"), C.sha256(F.col("merged")).alias("merged"), F.length("tables").alias("tables"), F.length("isolated").alias("isolated"))


@query(S.DOC_ISSUES)
def doc_issues(spark, sf_dir):
    return gates.markdown_issues(table(spark, sf_dir, "documents"))


@query(S.DOC_VERDICTS)
def doc_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return gates.verdict(docs, gates.markdown_issues(docs))


@query()
def doc_summaries(spark, sf_dir):
    return report.summaries(table(spark, sf_dir, "documents")).drop("sections", "report")


@query(f"WITH {_LINES}, n AS (SELECT doc_id, number, content, first_value(CASE WHEN content <> '' THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM l) SELECT doc_id, CAST(number AS INTEGER) AS number, following FROM n")
def next_non_blank(spark, sf_dir):
    return lines.next_non_blank(_lines(spark, sf_dir)).select("doc_id", "number", F.col("next.content").alias("following"))


@query(f"WITH {_LINES}, e AS (SELECT doc_id, number, regexp_replace(content, '\\\\.', '', 'g') AS x FROM l), m AS (SELECT doc_id, number, (length(x) - length(replace(x, '$$', ''))) // 2 AS k FROM e), p AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY number) - k AS before FROM m) SELECT doc_id, CAST(number AS INTEGER) AS number, before % 2 = 1 OR k > 0 AS in_formula FROM p")
def formula_line_parity(spark, sf_dir):
    return lines.formula_parity(_lines(spark, sf_dir)).select("doc_id", "number", "in_formula")


@query("SELECT conv_id, turn, role, coalesce(lag(text) OVER w, '') AS context_before, coalesce(lead(text) OVER w, '') AS context_after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_context(spark, sf_dir):
    return blocks.context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "role", "context_before", "context_after")


@query("SELECT conv_id, role, turn, turn - lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS step FROM conversations QUALIFY step <> 1")
def version_gaps(spark, sf_dir):
    """Turns of a role that don't follow that role's last one directly."""
    step = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", step.alias("step")).where("step <> 1")


@query("SELECT conv_id AS batch, count(*) FILTER (role = 'user') AS succeeded, count(*) FILTER (role <> 'user') AS failed, bool_and(role = 'user') AS all_ok, coalesce(string_agg(CASE WHEN role <> 'user' THEN lpad(CAST(turn AS VARCHAR), 6, '0') END, ',' ORDER BY turn), '') AS failed_ids FROM conversations GROUP BY conv_id")
def batch_outcome(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("id"), (F.col("role") == "user").alias("ok"))
    return state.outcome(r).withColumn("failed_ids", F.array_join("failed_ids", ","))


@query(
    """WITH c AS (SELECT conv_id AS region_id, turn AS event_no, CASE WHEN role = 'assistant' THEN 'accepted' ELSE 'rejected' END AS decision FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    a AS (SELECT region_id, count(*) AS attempts, max(event_no) AS event_no, arg_max(decision, event_no) AS decision, max(event_no) FILTER (WHERE decision = 'accepted') AS accepted FROM c GROUP BY region_id)
    SELECT a.region_id, attempts, a.event_no, a.decision, CAST(count(c.region_id) AS BIGINT) AS pending FROM a LEFT JOIN c ON c.region_id = a.region_id AND c.decision = 'rejected' AND c.event_no > coalesce(accepted, -1) GROUP BY ALL"""
)
def stream_decisions(spark, sf_dir):
    """Conversations as a stream of questions (open) and answers (accepted): the state that each of them ends in."""
    at = shared_folder(spark, "decisions")
    turns = incremental.stream(spark, f"{sf_dir}/conversations.parque[t]", "conv_id long, turn long, role string, text string")
    decision = F.when(F.col("role") == "assistant", "accepted").otherwise("rejected")
    events = turns.select(F.col("conv_id").alias("region_id"), F.col("turn").alias("event_no"), decision.alias("decision"))
    keyed.run_decisions(spark, events, f"{at}/out", f"{at}/state").awaitTermination()
    rows = spark.read.schema(keyed.OUTPUT.format(key="long")).parquet(f"{at}/out")
    last = rows.groupBy("region_id").agg(F.max_by(F.struct("attempts", "event_no", "decision", "pending"), "version").alias("x"))
    return last.select("region_id", "x.*")
