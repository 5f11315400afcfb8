"""Document lifecycle as DataFrame to DataFrame: replace, upsert, cascade, versions, transitions, collaborators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Legal next states.
TRANSITIONS = {"not processed": ["extracted"], "extracted": ["chunked"], "chunked": ["processed"], "processed": []}


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of the parents in ``new`` are replaced, the others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(doomed: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table (by name: frame and its document key) without the rows of the documents in ``doomed`` (id)."""
    return {name: df.join(doomed.select(F.col("id").alias(key)), key, "left_anti") for name, (df, key) in tables.items()}


def upsert_counts(events: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key: how often, first and last seen."""
    return events.groupBy(key).agg(F.count("*").alias("search_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def number_versions(rows: DataFrame, owner: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """``version_number``: consecutive from the owner's largest existing number (0 without one)."""
    numbered = rows.withColumn("version_number", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    if existing is None:
        return numbered
    top = existing.groupBy(owner).agg(F.max("version_number").alias("_top"))
    return numbered.join(top, owner, "left").withColumn("version_number", F.coalesce("_top", F.lit(0)) + F.col("version_number")).drop("_top")


def restore_version(versions: DataFrame, current: DataFrame, owner: int, number: int) -> DataFrame:
    """The versions with a backup of the current content added, then the restored one (document_id, version_number, content)."""
    last = versions.where(F.col("document_id") == owner).agg(F.coalesce(F.max("version_number"), F.lit(0)).alias("n"))
    backup = current.where(F.col("document_id") == owner).crossJoin(F.broadcast(last)).select("document_id", (F.col("n") + 1).alias("version_number"), "content")
    old = versions.where((F.col("document_id") == owner) & (F.col("version_number") == number)).crossJoin(F.broadcast(last))
    return versions.select("document_id", "version_number", "content").unionByName(backup).unionByName(old.select("document_id", (F.col("n") + 2).alias("version_number"), "content"))


def may_move(now: Column, then: Column, transitions: dict[str, list[str]] = TRANSITIONS) -> Column:
    legal = F.create_map(*[x for k, v in transitions.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.array_contains(legal[now], then), F.lit(False))


def add_collaborators(current: DataFrame, new: DataFrame) -> DataFrame:
    """Adds (document_id, user_id, permission_level, is_active); pairs already there, active or not, are rejected."""
    first = new.dropDuplicates(["document_id", "user_id"])
    return current.unionByName(first.join(current, ["document_id", "user_id"], "left_anti").select(current.columns))


def remove_collaborator(current: DataFrame, document_id: int, user_id: int) -> DataFrame:
    gone = (F.col("document_id") == document_id) & (F.col("user_id") == user_id)
    return current.withColumn("is_active", F.when(gone, F.lit(False)).otherwise(F.col("is_active")))


def resolve_comments(comments: DataFrame, ids: DataFrame) -> DataFrame:
    """Comments whose id is in ``ids`` (comment_id) are resolved."""
    hit = ids.select("comment_id").distinct().withColumn("_hit", F.lit(True))
    return comments.join(hit, "comment_id", "left").withColumn("is_resolved", F.coalesce("_hit", "is_resolved")).drop("_hit")


def append_activity(log: DataFrame, activity: DataFrame) -> DataFrame:
    return log.unionByName(activity.select(log.columns))


def latest_state(jobs: DataFrame, key: str, at: str) -> DataFrame:
    """The last event of each job (ties: the largest event)."""
    rest = [c for c in jobs.columns if c not in (key, at)]
    return jobs.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("e")).select(key, "e.*")


def valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(*TRANSITIONS), F.lit(False))


def pending(documents: DataFrame) -> DataFrame:
    """Documents still to extract: without content and not processed."""
    return documents.where(F.col("content").isNull() & (F.col("status") == "not processed"))


def changed(documents: DataFrame, known: DataFrame, key: str = "id", stamp: str = "content_hash") -> DataFrame:
    """New documents and those whose stamp differs from the known one (key, stamp): what an incremental run takes; a null stamp that is known as null has not changed."""
    seen = known.select(F.col(key).alias("_key"), F.col(stamp).alias("_stamp"))
    return documents.join(seen, (F.col(key) == F.col("_key")) & F.col(stamp).eqNullSafe(F.col("_stamp")), "left_anti")


def rechunk(documents: DataFrame, old: DataFrame, chunker) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after chunking all documents (doc_id, text, status) with a text whose status is extracted or not processed: their chunks are replaced, their status becomes chunked."""
    due = (F.length("text") > 0) & F.col("status").isin("extracted", "not processed")
    made = chunker(documents.where(due).select("doc_id", "text")).select(old.columns)
    stay = old.join(documents.where(due).select("doc_id").distinct(), "doc_id", "left_anti").select(old.columns)  # a text without any chunk loses its old ones too
    return documents.withColumn("status", F.when(due, "chunked").otherwise(F.col("status"))), stay.unionByName(made)


def backfill(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """The column filled where it is null."""
    return rows.withColumn(column, F.coalesce(column, value))


def tagged(vectors: DataFrame, known: DataFrame, provider: str, model: str) -> DataFrame:
    """``known`` vectors (chunk_id, embedding, provider, model) with those of chunks that have none of this provider and model yet."""
    new = vectors.select("chunk_id", "embedding").withColumn("provider", F.lit(provider)).withColumn("model", F.lit(model))
    return known.unionByName(new.join(known.select("chunk_id", "provider", "model"), ["chunk_id", "provider", "model"], "left_anti").select(known.columns))


def provider_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("provider", "model").agg(F.count("*").alias("n"))


def queue(jobs: DataFrame) -> DataFrame:
    """``place`` of each job (job_id, priority, created_at): higher priority first, then the earlier."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "created_at", "job_id")))
