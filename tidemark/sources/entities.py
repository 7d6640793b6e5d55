"""The canonical entities with declared schemas, and what happens to rows that don't fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of each entity; those marked NOT NULL must be there and filled.
ENTITIES = {
    "companies": "id bigint NOT NULL, name string NOT NULL, slug string NOT NULL, canonical_domain string, aliases array<string>, industry string, stage string, description string, is_active boolean, created_at timestamp",
    "sources": "id bigint NOT NULL, company_id bigint, url string NOT NULL, source_type string NOT NULL, fetch_tier string, status string, next_crawl_at timestamp, consecutive_failures bigint, content_hash string, last_successful_crawl timestamp, created_at timestamp",
    "events": "id bigint NOT NULL, company_id bigint NOT NULL, event_type string NOT NULL, title string NOT NULL, occurred_at timestamp, observed_at timestamp NOT NULL, confidence double, source_count bigint, source_url string, is_canonical boolean, status string",
    "jobs": "id bigint NOT NULL, company_id bigint NOT NULL, external_id string, title string NOT NULL, department string, role_family string, seniority string, work_mode string, description_text string, content_hash string, is_active boolean, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, embedding array<float>",
    "scores": "company_id bigint NOT NULL, scored_at timestamp NOT NULL, momentum_score double NOT NULL, momentum_label string NOT NULL, score_delta double, signal_strength double",
    "fetches": "source_id bigint NOT NULL, company_id bigint, source_type string NOT NULL, fetched_at timestamp NOT NULL, url string, text string",
}


def declared(name: str) -> StructType:
    """The schema of an entity."""
    return StructType.fromDDL(ENTITIES[name])


def conform(df: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows in the declared schema; refused rows as row (JSON text) and reasons).

    A column that is missing counts as null, one that isn't declared goes. A value is cast; one that can't be, and a null where the schema has none, is a
    reason (``column: type`` or ``column: null``) to refuse its row. Both results read the input once each and keep its partitions.
    """
    there = set(df.columns)
    made, reasons = [], []
    for field in schema:
        raw = F.col(f"`{field.name}`") if field.name in there else F.lit(None)
        plain = field.name in there and df.schema[field.name].dataType == field.dataType
        value = raw if plain else raw.cast(field.dataType) if field.dataType.typeName() in ("array", "map", "struct") else raw.try_cast(field.dataType)
        made.append(value.alias(field.name))
        bad = F.when(raw.isNotNull() & value.isNull(), F.lit(f"{field.name}: {field.dataType.simpleString()}"))
        reasons.append(bad if field.nullable else bad.when(raw.isNull(), F.lit(f"{field.name}: null")))
    judged = df.withColumn("__tm_reasons", F.array_compact(F.array(*reasons)))
    kept = judged.filter(F.size("__tm_reasons") == 0).select(*made)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if df.columns else F.lit("{}")
    return kept, judged.filter(F.size("__tm_reasons") > 0).select(row.alias("row"), F.col("__tm_reasons").alias("reasons"))


def read_entity(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """The rows of an entity's files in its schema, and the refused ones; see ``conform``. CSV files must have a header."""
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    return conform(reader.format(fmt).load(path), declared(name))


def refusals(refused: DataFrame) -> DataFrame:
    """reason, n: how many rows each reason refused; a row may have several."""
    return refused.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
