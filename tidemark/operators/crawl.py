"""The incremental crawl: batches of fetches become changed documents, routed events, canonical events with evidence, and scores of touched companies.

State lives in tables under one folder, a part for each batch (``batch=N``). A batch reads only parts of earlier batches and overwrites its own, so a batch
that runs again after a failure leaves the tables as one run would. Later batches never rewrite what is stored: an event's evidence and
a company's scores are what the parts so far add up to.

| Table | Columns of a part |
|---|---|
| hashes | source_id, fetched_at, content_hash: the last content of each source of the batch |
| reports | the routed events with canonical_id: a leader names itself, the others the leader they are evidence of |
| scores | company_id, scored_at, momentum_score, momentum_label, signal_strength, n_events of the touched companies |
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.operators import dedup as D
from tidemark.operators import mentions as M
from tidemark.operators import scores as C
from tidemark.sources.steps import discard, settle

HASHES = "source_id long, fetched_at timestamp, content_hash string"


def parts_before(spark: SparkSession, store: str, name: str, number: int, schema: StructType | str) -> DataFrame:
    """Rows of a table's parts of earlier batches, with their batch; none if there are none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0)).limit(0)
    return spark.read.schema(schema).parquet(f"{store}/{name}").select("*", F.col("batch").cast("int").alias("__tm_batch")).drop("batch").withColumnRenamed("__tm_batch", "batch").filter(F.col("batch") < number)


def write_part(df: DataFrame, store: str, name: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")


def changed_fetches(batch: DataFrame, last: DataFrame) -> DataFrame:
    """The batch's fetches whose content differs from the one before of its source, in the batch or stored; last: source_id, content_hash.

    Fetches of one source at one time are taken in the order of their hashes.
    """
    rows = batch.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    before = F.lag("content_hash").over(Window.partitionBy("source_id").orderBy("fetched_at", "content_hash"))
    rows = rows.withColumn("__tm_before", before).join(last.select("source_id", F.col("content_hash").alias("__tm_last")), "source_id", "left")
    return rows.filter(~F.col("content_hash").eqNullSafe(F.coalesce("__tm_before", "__tm_last"))).drop("__tm_before", "__tm_last")


def fit_fetches(changed: DataFrame) -> DataFrame:
    """Those that pass the relevance filter."""
    return changed.filter(T.passes(T.prefilter(F.col("text"), F.col("source_type"))))


def relevant_fetches(changed: DataFrame, companies: DataFrame) -> DataFrame:
    """Those that pass the relevance filter and, where no company is attached, name a tracked company somewhere."""
    return attributable(fit_fetches(changed), companies)


def attributable(fit: DataFrame, companies: DataFrame) -> DataFrame:
    """Fetches that have a company attached or name a tracked one somewhere."""
    fit = fit.withColumn("__tm_doc", F.xxhash64("source_id", "fetched_at", "content_hash"))
    loose = fit.filter("company_id IS NULL").select(F.col("__tm_doc").alias("doc_id"), "text")
    named = M.find_mentions(loose, companies).select(F.col("doc_id").alias("__tm_doc")).distinct()
    own = fit.filter("company_id IS NOT NULL")
    return own.unionByName(fit.filter("company_id IS NULL").join(named, "__tm_doc", "left_semi")).drop("__tm_doc")


def resolved(events: DataFrame, stored: DataFrame, number: int, days: int) -> tuple[DataFrame, str]:
    """The batch's events with canonical_id, held against stored leaders of their company and type within ``days`` of the batch; and the path of a table they are read from, for ``discard``."""
    when = F.coalesce("occurred_at", "observed_at") if "occurred_at" in events.columns else F.col("observed_at")
    span = F.expr(f"INTERVAL {days} DAYS")
    reach = events.groupBy("company_id", "event_type").agg((F.min(when) - span).alias("__tm_from"), (F.max(when) + span).alias("__tm_to"))
    leaders = stored.filter(F.col("canonical_id") == F.col("event_id")).withColumn("__tm_when", when).join(reach, ["company_id", "event_type"])
    leaders = leaders.filter(F.col("__tm_when").between(F.col("__tm_from"), F.col("__tm_to"))).select(*events.columns, "batch")
    both = leaders.unionByName(events.withColumn("batch", F.lit(number))).withColumnRenamed("event_id", "id")
    found, facts_at = D.deduped(both, days, order=("batch", "id"))
    return events.join(found.select(F.col("id").alias("event_id"), "canonical_id"), "event_id"), facts_at


def canonical_events(reports: DataFrame) -> DataFrame:
    """id, company_id, event_type, title, times of each leader with source_count, evidence (distinct URLs, as they came) and confidence over its reports.

    A report whose URL was seen before changes nothing, not even the confidence.
    """
    came = F.struct("batch", F.col("event_id").alias("id"))
    sure = F.col("confidence") if "confidence" in reports.columns else F.lit(None).cast("double")
    first = reports.groupBy("canonical_id", "source_url").agg(F.min(came).alias("came"), F.min_by(sure, came).alias("confidence"))
    urls = F.transform(F.array_sort(F.collect_list(F.when(F.col("source_url").isNotNull(), F.struct("came", "source_url")))), lambda e: F.struct(e["source_url"].alias("source_url")))
    gathered = first.groupBy("canonical_id").agg(F.count("*").alias("source_count"), F.max("confidence").alias("confidence"), urls.alias("evidence"))
    lead = reports.filter(F.col("canonical_id") == F.col("event_id"))
    occurred = F.col("occurred_at") if "occurred_at" in reports.columns else F.lit(None).cast("timestamp")
    lead = lead.select(F.col("event_id").alias("id"), "company_id", "event_type", "title", "observed_at", occurred.alias("occurred_at"))
    return lead.join(gathered.withColumnRenamed("canonical_id", "id"), "id")


def scored_events(reports: DataFrame) -> DataFrame:
    """What scores take of ``canonical_events``: company_id, event_type, times, source_count and factor, that of the best tier among the URLs; nothing is gathered in lists."""
    factor = F.max(S.tier_factor(S.source_tier(F.col("source_url")))).alias("factor")
    gathered = reports.select("canonical_id", "source_url").distinct().groupBy("canonical_id").agg(F.count("*").alias("source_count"), factor)
    occurred = F.col("occurred_at") if "occurred_at" in reports.columns else F.lit(None).cast("timestamp")
    lead = reports.filter(F.col("canonical_id") == F.col("event_id")).select("canonical_id", "company_id", "event_type", "observed_at", occurred.alias("occurred_at"))
    return lead.join(gathered, "canonical_id")


def company_scores(events: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """Scores of the given companies from their ``canonical_events`` or ``scored_events``, each by the best tier of its evidence."""
    rows = C.momentum_scores(events, companies, as_of)
    return rows.select("company_id", as_of.cast("timestamp").alias("scored_at"), "momentum_score", "momentum_label", "signal_strength", "n_events")


def crawl_batch(batch: DataFrame, number: int, store: str, events_of: Callable[[DataFrame], DataFrame], companies: DataFrame, as_of: Column, days: int = 14) -> None:
    """One batch through the whole pipeline; see ``run_crawl``."""
    spark, loose = batch.sparkSession, F.col("company_id").isNull()
    hashed = batch.select("source_id", "fetched_at", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    newest = hashed.groupBy("source_id").agg(F.max(F.struct("fetched_at", "content_hash")).alias("r")).select("source_id", "r.*")
    write_part(newest, store, "hashes", number)
    came = spark.read.schema(HASHES).parquet(f"{store}/hashes/batch={number}").select("source_id")
    hashes = parts_before(spark, store, "hashes", number, HASHES).join(came, "source_id", "left_semi")
    last = hashes.groupBy("source_id").agg(F.max_by("content_hash", F.struct("batch", "fetched_at")).alias("content_hash"))
    # documents and events are read several times, and events come from a model: both are made once. Names are searched only if something has no company
    fit, fit_at = settle(fit_fetches(changed_fetches(batch, last)), "fetches")
    docs = fit if fit.filter(loose).isEmpty() else attributable(fit, companies)
    events, *made = settle(events_of(docs), "events")
    if not events.filter(loose).isEmpty():
        events, routed_at = settle(M.route_events(events, companies), "routed")
        made.append(routed_at)
    stored = parts_before(spark, store, "reports", number, events.withColumn("canonical_id", F.lit(0).cast("long")).schema)
    reports, facts_at = resolved(events, stored, number, days)
    write_part(reports, store, "reports", number)
    discard(spark, fit_at, *made, facts_at)
    now = spark.read.parquet(f"{store}/reports/batch={number}").withColumn("batch", F.lit(number))
    touched = now.select("company_id").distinct()
    of_touched = stored.join(touched, "company_id", "left_semi").unionByName(now)
    scored = company_scores(scored_events(of_touched), companies.join(touched.withColumnRenamed("company_id", "id"), "id", "left_semi"), as_of)
    write_part(scored, store, "scores", number)


def run_crawl(fetches: DataFrame, store: str, events_of: Callable[[DataFrame], DataFrame], companies: DataFrame, checkpoint: str, as_of: Column | Callable[[int], Column], days: int = 14) -> StreamingQuery:
    """A streaming query over fetches (source_id, company_id, source_type, fetched_at, url, text) that keeps the tables under ``store``.

    ``events_of`` makes events of documents: event_id long (unique), title, context, company_id, event_type, observed_at, source_url and what an event has (occurred_at, confidence,
    facts). They are routed, join the canonical events stored so far within ``days`` or become canonical, and the companies they touch get a new score as of ``as_of``
    (a column, or a function of the batch's number); all others keep theirs. companies: id, name, aliases.
    """

    def step(batch: DataFrame, number: int) -> None:
        crawl_batch(batch, number, store, events_of, companies, as_of(number) if callable(as_of) else as_of, days)

    return fetches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def crawled_events(spark: SparkSession, store: str) -> DataFrame:
    """All canonical events with their evidence so far."""
    return canonical_events(spark.read.parquet(f"{store}/reports"))


def crawled_scores(spark: SparkSession, store: str) -> DataFrame:
    """The newest score of each company that ever was touched."""
    rows = spark.read.parquet(f"{store}/scores")
    fields = [c for c in rows.columns if c not in ("company_id", "batch")]
    return rows.groupBy("company_id").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("company_id", "r.*")
