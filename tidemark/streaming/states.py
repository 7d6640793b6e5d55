"""Operators on streams whose state is a list or a value of its own for each key, with timers that clear it.

They need the RocksDB state store, which writes only what changed, so each sets it on the session before the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators import extraction as E
from tidemark.operators.dedup import DAY, TOPIC_OF, as_facts

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Leaders(StatefulProcessor):
    """One entry of a list for each leader of a (company, type, topic); a timer takes those that nothing can match any more."""

    STATE = "id long, t long, tokens string, round string, amount double, person string, role string, city string, target string"

    def __init__(self, span: int, overlap: float):
        self.span, self.overlap = span, overlap

    def init(self, handle) -> None:
        self.handle, self.leaders = handle, handle.getListState("leaders", self.STATE)

    def held(self) -> list[tuple]:
        return [(i, t, (set(tokens.split()), round_, amount, person, set(role.split()), city, target)) for i, t, tokens, round_, amount, person, role, city, target in self.leaders.get()] if self.leaders.exists() else []

    @staticmethod
    def entry(i: int, t: int, f: tuple) -> tuple:
        tokens, round_, amount, person, role, city, target = f
        return i, t, " ".join(sorted(tokens)), round_, amount, person, " ".join(sorted(role)), city, target

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        company, kind, _ = key
        pdf = pd.concat(list(rows)).sort_values(["t", "id"])
        leaders, new, out = self.held(), [], []
        for i, t, f in zip(pdf["id"].tolist(), pdf["t"].tolist(), zip(*(pdf[c] for c in E.FACT_COLUMNS), strict=True), strict=True):
            own = as_facts(f)
            out.append(next((j for j, u, other in leaders if abs(t - u) <= self.span and E.same_facts(kind or "", own, other, self.overlap)), i))
            if out[-1] == i:
                leaders.append((i, t, own))
                new.append(self.entry(i, t, own))
        if new:
            self.leaders.appendList(new)
            self.handle.registerTimer(max(min(n[1] for n in new) // 1000, timerValues.getCurrentWatermarkInMs()) + self.span // 1000 + 1)
        yield pd.DataFrame({"company_id": pd.array([company] * len(pdf), "Int64"), "event_type": [kind] * len(pdf), "id": pdf["id"].to_numpy(), "canonical_id": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        left = [x for x in self.held() if x[1] >= mark - self.span]
        if left:
            self.leaders.put([self.entry(*x) for x in left])
            self.handle.registerTimer(min(x[1] for x in left) // 1000 + self.span // 1000 + 1)
        else:
            self.leaders.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_dedup(reports: DataFrame, days: int = 14, overlap: float = E.TITLE_OVERLAP, late: str = "1 hour") -> DataFrame:
    """company_id, event_type, id, canonical_id of each report on a stream, as ``dedup_events`` finds them when reports come in time order.

    reports: id long, company_id long, event_type string, title string, observed_at timestamp, and what an event has (round, amount_usd, person, role, city, target).
    State is a list of leaders for each company, type and topic (what two reports must share; one topic for types told apart by titles): a leader is
    an entry, appended once; when the watermark is ``days`` past a leader, a timer drops it. Reports later than ``late`` go, as watermarks have it.
    """
    use_rocksdb(reports.sparkSession)
    topic = F.lit("")
    for name, column in TOPIC_OF.items():
        topic = F.when(F.col("event_type") == name, F.col(column)).otherwise(topic)
    rows = reports.withWatermark("observed_at", late).select("company_id", "event_type", "id", "observed_at", F.unix_micros("observed_at").alias("t"), *E.facts(reports))
    keyed = rows.withColumn("topic", F.coalesce(topic, F.lit(""))).groupBy("company_id", "event_type", "topic")
    return keyed.transformWithStateInPandas(Leaders(days * DAY, overlap), "company_id long, event_type string, id long, canonical_id long", "Append", "EventTime")


class DayCount(StatefulProcessor):
    """Allowed calls of one key and UTC day so far; gone when the day is over by the watermark."""

    def __init__(self, key: str, ts: str, tie: str, limit: int):
        self.columns, self.ts, self.tie, self.limit = [key, ts, tie], ts, tie, limit

    def init(self, handle) -> None:
        self.handle, self.used = handle, handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.used.exists()
        used = self.used.get()[0] if known else 0
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.tie])
        allowed = [n < self.limit for n in range(used, used + len(pdf))]
        self.used.update((used + len(pdf),))
        if not known:
            self.handle.registerTimer((key[1] + 1) * (DAY // 1000))
        yield pdf[self.columns].assign(allowed=allowed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_quota_calls(calls: DataFrame, key: str, ts: str, tie: str, limit: int, late: str = "1 hour") -> DataFrame:
    """key, ts, tie and allowed of each call on a stream: the first ``limit`` calls of a key and UTC day, as they come, are allowed.

    key and tie are longs, ts a timestamp. Calls are taken batch by batch, in time order within one. A late call counts for the day it was made on until the watermark
    (``late`` behind the newest call) has passed that day's end, when the day's count goes; a call later than that goes too, as watermarks have it.
    """
    use_rocksdb(calls.sparkSession)
    day = F.floor(F.unix_micros(ts) / F.lit(DAY)).alias("day")
    rows = calls.select(key, ts, tie).withWatermark(ts, late).select(key, ts, tie, day)
    return rows.groupBy(key, "day").transformWithStateInPandas(DayCount(key, ts, tie, limit), f"{key} long, {ts} timestamp, {tie} long, allowed boolean", "Append", "EventTime")
