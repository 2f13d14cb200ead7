"""State tables: block manifests, completion stages, decision logs, glossaries, retention, configuration drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("merge", "render", "verify", "review")
MAX_ATTEMPTS = 3


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last accepted decision of each region in an append-only log (event_no, event, region_id, decision, status)."""
    fine = log.where("event = 'ambiguity_decision' and status = 'passed'")
    return fine.groupBy("region_id").agg(F.max_by("decision", "event_no").alias("decision"), F.max("event_no").alias("event_no"))


def attempts(log: DataFrame) -> DataFrame:
    return log.where("event = 'ambiguity_decision'").groupBy("region_id").agg(F.max("attempt").alias("attempts"))


def transition(manifest: DataFrame, outputs: DataFrame, replace_accepted: bool = False, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The manifest (block_id, status, attempts, revisions, last_error) after outputs (block_id, valid, error).

    Accepted blocks don't change unless replaced, which counts a revision; a failed replacement keeps what was accepted.
    A block whose attempts are used up stays as it is.
    """
    m = manifest.join(outputs.select("block_id", "valid", F.col("error").alias("new_error")), "block_id", "left")
    accepted = F.col("status") == "accepted"
    seen = F.col("valid").isNotNull() & ((~accepted & (F.col("attempts") < most)) | (accepted & F.lit(replace_accepted)))
    status = F.when(seen & F.col("valid"), "accepted").when(seen & ~accepted, "failed").otherwise(F.col("status"))
    return m.select(
        "block_id",
        status.alias("status"),
        (F.col("attempts") + F.when(seen & ~accepted, 1).otherwise(0)).alias("attempts"),
        (F.col("revisions") + F.when(seen & accepted & F.col("valid"), 1).otherwise(0)).alias("revisions"),
        F.when(seen, F.when(F.col("valid"), "").otherwise(F.col("new_error"))).otherwise(F.col("last_error")).alias("last_error"),
    )


def replanned(manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    """A manifest for a new plan (block_id, surface_sha256): accepted blocks whose surface is the same keep their state."""
    old = manifest.where("status = 'accepted'").select("block_id", "surface_sha256", "status", "attempts", "revisions", "last_error")
    new = blocks.join(old, ["block_id", "surface_sha256"], "left")
    return new.select("block_id", "surface_sha256", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("revisions", F.lit(0)).alias("revisions"), F.coalesce("last_error", F.lit("")).alias("last_error"))


def _index(column: str = "stage"):
    return F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col(column))


def record_stage(completion: DataFrame, events: DataFrame) -> DataFrame:
    """completion (doc_id, stage, artifact, sha256) with the events' rows; each event drops its own and all later stages."""
    least = events.groupBy("doc_id").agg(F.min(_index()).alias("from"))
    kept = completion.join(least, "doc_id", "left").where(F.col("from").isNull() | (_index() < F.col("from"))).select("doc_id", "stage", "artifact", "sha256")
    return kept.unionByName(events.select("doc_id", "stage", "artifact", "sha256"))


def completion_gaps(docs: DataFrame, completion: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(doc_id, stage, reason) of what stands between a document and its clean-up: stages absent, or with an outdated artifact."""
    wanted = docs.select("doc_id").distinct().withColumn("stage", F.explode(F.array(*(F.lit(s) for s in STAGES))))
    rows = wanted.join(completion, ["doc_id", "stage"], "left").join(artifacts.select(F.col("artifact"), F.col("sha256").alias("now")), "artifact", "left")
    reason = F.when(F.col("artifact").isNull(), "missing").when(F.col("now").isNull(), "artifact gone").when(F.col("now") != F.col("sha256"), "artifact changed")
    return rows.select("doc_id", "stage", reason.alias("reason")).where("reason is not null")


def reviewable(completion: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, reason) of reviews that may not be recorded: before verification, of another artifact, or empty."""
    verify = completion.where("stage = 'verify'").select("doc_id", F.col("sha256").alias("verified"))
    rows = reviews.join(verify, "doc_id", "left")
    reason = F.when(F.col("verified").isNull(), "not verified").when(F.col("verified") != F.col("sha256"), "another artifact").when(F.coalesce(F.trim("review"), F.lit("")) == "", "empty review")
    return rows.select("doc_id", reason.alias("reason")).where("reason is not null")


def merge_glossary(terms: DataFrame, updates: DataFrame, replace: bool = False) -> DataFrame:
    """term, translation, state (kept, added, same, conflict, replaced); a conflict keeps the old translation."""
    both = terms.select("term", F.col("translation").alias("old")).join(updates.select("term", F.col("translation").alias("new")), "term", "full_outer")
    state = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "same").otherwise("replaced" if replace else "conflict")
    chosen = F.when(state == "conflict", F.col("old")).otherwise(F.coalesce("new", "old"))
    return both.select("term", chosen.alias("translation"), state.alias("state"))


def to_delete(folders: DataFrame, most_bytes: int = 50 * 1024 * 1024, keep: int = 20) -> DataFrame:
    """Folders (path, ts, bytes) that retention removes: oldest first, while there are too many or too many bytes, never the last ``keep``."""
    newest = folders.orderBy(F.desc("ts"), F.desc("path")).limit(keep).agg(F.min(F.struct("ts", "path")).alias("least"))
    totals = folders.agg(F.sum("bytes").alias("total"), F.count("*").alias("n"))
    # Both are one row.
    rows = folders.join(F.broadcast(newest.join(totals)))
    too_many = (F.col("total") > most_bytes) | (F.col("n") > keep)
    return rows.where(too_many & (F.struct("ts", "path") < F.col("least"))).select("path", "ts", "bytes")


def drift(example: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys (grp, key, type) that are missing, extra or of another type; a group without any key is one row with a null key."""
    a = example.select("grp", "key", F.col("type").alias("wanted"))
    b = actual.select("grp", "key", F.col("type").alias("found"))
    lost = a.select("grp").distinct().join(b.select("grp").distinct(), "grp", "left_anti")
    rows = a.join(lost, "grp", "left_anti").join(b, ["grp", "key"], "full_outer")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("wanted") != F.col("found"), "type")
    keys = rows.select("grp", "key", state.alias("state")).where("state is not null")
    return keys.unionByName(lost.select("grp", F.lit(None).cast("string").alias("key"), F.lit("missing group").alias("state")))


def outcome(results: DataFrame, key: str = "batch") -> DataFrame:
    """Tally of a batch: any failure fails it, successes are kept; failed ids in order."""
    return results.groupBy(key).agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.every("ok").alias("all_ok"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("id")))).alias("failed_ids"))


def retry_schedule(failures: DataFrame, most: int = 3) -> DataFrame:
    """When each failed request (id, attempt, retry_after) runs again: what the server said, else 2 ** attempt seconds."""
    wait = F.coalesce(F.col("retry_after").cast("double"), F.pow(F.lit(2.0), F.col("attempt")))
    return failures.withColumn("wait_seconds", F.when(F.col("attempt") < most, wait))
