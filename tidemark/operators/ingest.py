"""What the crawl writes: scores, logs, embeddings, uploads, and the incremental pipeline over new fetches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

MAX_LOG_TEXT, MAX_ERROR = 5000, 1000


def append_scores(scores: DataFrame, path: str) -> None:
    """Adds scores to the series at ``path``, a folder for each date; nothing written before is changed."""
    scores.withColumn("score_date", F.to_date("scored_at")).write.mode("append").partitionBy("score_date").parquet(path)


def shape_crawl_log(fetches: DataFrame) -> DataFrame:
    """cleaned_text and error_message cut to what a log keeps; empty texts are null."""
    cut = lambda c, n: F.nullif(F.substring(c, 1, n), F.lit(""))
    return fetches.withColumns({"cleaned_text": cut("cleaned_text", MAX_LOG_TEXT), "error_message": cut("error_message", MAX_ERROR)})


def erase(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Without any row of the given keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


def copy_sibling_vectors(jobs: DataFrame) -> DataFrame:
    """jobs with missing embeddings filled from a job of the same content_hash and title (the least id that has one)."""
    donors = jobs.filter("embedding IS NOT NULL AND content_hash IS NOT NULL").groupBy("content_hash", "title").agg(F.min_by("embedding", "id").alias("__tm_v"))
    return jobs.join(donors, ["content_hash", "title"], "left").withColumn("embedding", F.coalesce("embedding", "__tm_v")).select(*jobs.columns)


def embedding_worklist(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """digest, text, members (ids): a row for each distinct text, letter case and white space aside, of active jobs without a vector; oldest first if limited."""
    todo = jobs.filter("is_active AND embedding IS NULL")
    todo = todo.orderBy("first_seen_at", "id").limit(limit) if limit is not None else todo
    text = T.job_embedding_text(*[F.col(c) for c in ("title", "department", "role_family", "description_text")])
    rows = todo.select("id", text.alias("text")).filter("text != ''").withColumn("digest", T.content_hash(F.col("text"), normalised=True))
    return rows.groupBy("digest").agg(F.min_by("text", "id").alias("text"), F.sort_array(F.collect_list("id")).alias("members"))


def fan_out(vectors: DataFrame, worklist: DataFrame) -> DataFrame:
    """id, embedding of the worklist's members; vectors: digest, embedding (null where the provider failed)."""
    return worklist.join(vectors, "digest", "left").select(F.explode("members").alias("id"), "embedding")


def embedding_counts(before: DataFrame, copied: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row processed, copied, embedded, failed: jobs without a vector at first, those a sibling gave one, those that got one, and the rest."""
    rows = before.filter("is_active AND embedding IS NULL").select("id").join(copied.select("id", F.col("embedding").isNotNull().alias("c")), "id")
    rows = rows.join(vectors.select("id", F.col("embedding").isNotNull().alias("e")), "id", "left").fillna(False, ["e"])
    return rows.agg(F.count("*").alias("processed"), F.count_if("c").alias("copied"), F.count_if(~F.col("c") & F.col("e")).alias("embedded"), F.count_if(~F.col("c") & ~F.col("e")).alias("failed"))


def plan_indexing(uploads: DataFrame, resumes: DataFrame) -> DataFrame:
    """uploads (user_id, file_hash) with needs_indexing and status: the same file that is ready stays so; a failed one, another or a first one is pending."""
    stored = resumes.select("user_id", F.col("file_hash").alias("__tm_hash"), F.col("indexing_status").alias("__tm_status"))
    ready = F.coalesce((F.col("__tm_hash") == F.col("file_hash")) & (F.col("__tm_status") == "ready"), F.lit(False))
    rows = uploads.join(stored, "user_id", "left")
    return rows.select(*uploads.columns, (~ready).alias("needs_indexing"), F.when(ready, "ready").otherwise("pending").alias("status"))


def run_incremental(fetches: DataFrame, last_hashes: Callable[[], DataFrame], write: Callable[[dict[str, DataFrame], int], None], events_of: Callable[[DataFrame], DataFrame], companies: DataFrame, checkpoint: str):
    """A streaming query that takes each batch of fetches (source_id, company_id, source_type, fetched_at, url, text) as far as routed events.

    For callers with a store of their own: ``last_hashes`` (source_id, content_hash) is read anew for each batch, ``write`` gets changed, events and touched
    (company_id) with the batch's number, by which it must be idempotent. ``crawl.run_crawl`` goes on to canonical events and scores.
    """
    from tidemark.operators import crawl as W
    from tidemark.operators import mentions as M

    def step(batch: DataFrame, number: int) -> None:
        changed = W.changed_fetches(batch, last_hashes())
        events = M.route_events(events_of(W.relevant_fetches(changed, companies)), companies)
        write({"changed": changed.drop("content_hash"), "events": events, "touched": events.select("company_id").distinct()}, number)

    return fetches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
