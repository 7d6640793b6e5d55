"""Event dedup: which reports are of one event, in arrival order, over an index of what two reports must share.

A report joins the first leader of its company and type that is of the same event and within the window, else it leads. Two reports can only
be of one event if they share a topic: the round of a funding, the person of a leadership change, the city of a new office, the target of an
acquisition; for other types a rare word of their titles. So a busy company is cut into its topics, topics into chains
where no neighbours in time lie more than the window apart, and a task reads its chains one after the other in arrival order. What it
holds of a chain are its leaders, by time, so that a report meets those of its own and the neighbouring windows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import extraction as E
from tidemark.sources.steps import discard, settle

DAY = 86_400_000_000
#: The column that two reports of a type must share; other types share title words.
TOPIC_OF = {"funding": "f_round", "leadership_change": "f_person", "new_office": "f_city", "acquisition": "f_target"}


def as_facts(f: tuple) -> tuple:
    """FACT_COLUMNS with tokens as sets and a missing amount as None."""
    tokens, round_, amount, person, role, city, target = f
    return set(tokens), round_, None if amount is None or amount != amount else amount, person, set(role), city, target


def title_topics(titles: DataFrame, overlap: float = E.TITLE_OVERLAP) -> DataFrame:
    """scope, sig, topic of distinct titles (scope, sig: sorted words joined by blanks): titles that may overlap have one topic.

    If more than a share ``overlap`` of the longer title's words is common, the titles also share one of their rarest words: of n words it is enough to
    look at the n - floor(overlap * n) rarest. Titles that share such a word get the least topic of theirs, round by round until nothing changes.
    Topics are hashes; two of one hash only make a chain longer.
    """
    spark = titles.sparkSession
    words = titles.select("scope", "sig", F.explode(F.split("sig", " ")).alias("word"))
    counts = words.groupBy("scope", "word").agg(F.count("*").alias("n"))
    rare = words.join(counts, ["scope", "word"]).groupBy("scope", "sig").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    index = rare.select("scope", "sig", F.explode(F.slice("w", 1, F.size("w") - F.floor(F.size("w") * F.lit(overlap)).cast("int"))).alias("w")).select("scope", "sig", F.col("w.word").alias("word"))
    index, index_at = settle(index, "title-words")
    now, at = settle(index.select("scope", "sig").distinct().withColumn("topic", F.xxhash64("scope", "sig")), "topics")
    while True:
        least = index.join(now, ["scope", "sig"]).groupBy("scope", "word").agg(F.min("topic").alias("topic"))
        new = index.join(least, ["scope", "word"]).groupBy("scope", "sig").agg(F.min("topic").alias("least"))
        nxt, nxt_at = settle(now.join(new, ["scope", "sig"]).select("scope", "sig", F.least("topic", "least").alias("topic"), (F.col("least") < F.col("topic")).alias("moved")), "topics")
        done = nxt.filter("moved").isEmpty()
        discard(spark, at)
        now, at = nxt.drop("moved"), nxt_at
        if done:
            discard(spark, index_at)
            return now


def chains(rows: DataFrame, keys: list[str], t: str, span: int) -> DataFrame:
    """rows with ``chain``: runs of a key in which no two neighbours in time lie more than ``span`` apart.

    A window of time as wide as the span holds no such gap, so it is enough to compare the first and last times of neighbouring windows; a
    key of any size is one row a window there.
    """
    cell = F.floor(F.col(t) / F.lit(span)).alias("cell")
    cells = rows.groupBy(*keys, cell).agg(F.min(t).alias("first"), F.max(t).alias("last"))
    over = Window.partitionBy(*keys).orderBy("cell")
    cut = F.coalesce(F.col("first") - F.lag("last").over(over) > span, F.lit(False)).cast("long")
    cells = cells.withColumn("cut", cut).withColumn("chain", F.sum("cut").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("cell", cell).join(cells.select(*keys, "cell", "chain"), [*keys, "cell"])


def dedup_events(reports: DataFrame, days: int = 14, overlap: float = E.TITLE_OVERLAP, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """id, canonical_id: each report in arrival order joins the first leader of its company and type within ``days`` that is of the same event, else leads.

    Rounds, amounts, persons, roles, cities and targets decide where the type has them (``extraction.same_event``), titles otherwise; a report's time is occurred_at,
    if there, else observed_at. ``order`` names the columns that reports came in by. Reports that no other can match (no person, city, target or title word) lead without a search.
    """
    return deduped(reports, days, overlap, order)[0]


def deduped(reports: DataFrame, days: int = 14, overlap: float = E.TITLE_OVERLAP, order: tuple[str, ...] = ("id",)) -> tuple[DataFrame, str]:
    """``dedup_events``, and the path of the table it is read from, for ``discard``.

    The reports with their facts are written there once: topics, chains and the search itself read them, and would each make them anew.
    """
    span, kind = days * DAY, F.coalesce("event_type", F.lit(""))
    when = F.coalesce("occurred_at", "observed_at") if "occurred_at" in reports.columns else F.col("observed_at")
    arrival = F.struct(*order).alias("came")
    scope = F.to_json(F.struct("company_id", "event_type")).alias("scope")
    fact, titled = dict(zip(E.FACT_COLUMNS, E.facts(reports), strict=True)), ~kind.isin(*TOPIC_OF)
    topic = F.lit(None).cast("string")
    for name, column in TOPIC_OF.items():
        topic = F.when(kind == name, fact[column] if name == "funding" else F.nullif(fact[column], F.lit(""))).otherwise(topic)
    # what else decides, by type; of one chain all share the topic
    words = F.when(titled, F.array_join(F.array_sort(fact["f_tokens"]), " ")).when(kind == "leadership_change", F.array_join(fact["f_role"], " "))
    decide = [topic.alias("topic"), F.nullif(words, F.lit("")).alias("words"), F.when(kind == "funding", fact["f_amount"]).alias("amount")]
    moment = F.coalesce(F.unix_micros(when.cast("timestamp")), F.lit(0)).alias("t")
    rows, rows_at = settle(reports.select("id", kind.alias("kind"), scope, moment, arrival, *decide), "facts")
    by_key, free = rows.filter(F.col("topic").isNotNull()), rows.filter(F.col("topic").isNull())
    told = ~F.col("kind").isin(*TOPIC_OF) & F.col("words").isNotNull()
    alone = free.filter(~told).select("id", F.col("id").alias("canonical_id"))
    titles = free.filter(told).drop("topic").withColumn("sig", F.col("words"))
    topics = title_topics(titles.select("scope", "sig").distinct(), overlap).withColumn("topic", F.col("topic").cast("string"))
    by_title = titles.join(topics, ["scope", "sig"]).select(*by_key.columns)
    keys, held = ["scope", "topic", "chain"], ["kind", "id", "t", "words", "amount"]
    dealt = chains(by_key.unionByName(by_title), ["scope", "topic"], "t", span).repartition(*keys).sortWithinPartitions(*keys, "came")

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, leaders, n = None, {}, 0
        for pdf in batches:
            out = []
            for key, kind, i, at, words, amount in zip(zip(*(pdf[c] for c in keys), strict=True), *(pdf[c] for c in held), strict=True):
                if key != chain:
                    chain, leaders, n = key, {}, 0
                said = words.split(" ") if words else ()
                own, cell = as_facts((said, key[1], amount, key[1], said, key[1], key[1])), at // span
                near = (x for c in (cell - 1, cell, cell + 1) for x in leaders.get(c, ()))
                same = [(rank, j) for rank, j, bt, other in near if abs(at - bt) <= span and E.same_facts(kind, own, other, overlap)]
                out.append(min(same)[1] if same else i)
                if not same:
                    leaders.setdefault(cell, []).append((n, i, at, own))
                    n += 1
            yield pd.DataFrame({"id": pdf["id"], "canonical_id": out})

    found = dealt.select(*keys, *held).mapInPandas(lead, "id long, canonical_id long")
    return found.unionByName(alone), rows_at
