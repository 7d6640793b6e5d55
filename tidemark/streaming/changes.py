"""Incremental forms of the batch operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window



def stream_changes(fetches: DataFrame, key: str = "source_id", order: str = "fetched_at") -> DataFrame:
    """Emits a fetch only if its hash differs from the last one of its key; going back to an older content does emit.

    fetches: key long, order timestamp, text string.
    """
    schema = f"{key} long, {order} timestamp, content_hash string"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        keep = []
        for h in rows["content_hash"]:
            keep.append(h != last)
            last = h
        state.update((last,))
        yield rows[keep][[key, order, "content_hash"]]

    hashed = fetches.select(key, order, F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return hashed.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def sliding_limit(calls: DataFrame, key: str, ts: str, n: int, seconds: int, tie: str) -> DataFrame:
    """Each call with ``allowed``: fewer than n allowed calls of its key in the ``seconds`` before it. Rejected calls don't count.

    A call that comes ``seconds`` or more after its key's previous one finds none before it, so calls are cut there into blocks that
    don't depend on each other; a task reads its sorted blocks one call at a time and holds at most n time stamps.
    """
    w = Window.partitionBy(key).orderBy(ts, tie)
    micros, span = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    rows = calls.withColumn("__tm_t", micros).withColumn("__tm_new", F.coalesce(F.col("__tm_t") - F.lag("__tm_t").over(w) >= span, F.lit(True)).cast("long"))
    rows = rows.withColumn("__tm_block", F.sum("__tm_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__tm_new")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, deque()
        for pdf in batches:
            out = []
            for k, b, t in zip(pdf[key], pdf["__tm_block"], pdf["__tm_t"], strict=True):
                if (k, b) != block:
                    block, held = (k, b), deque()
                out.append(_allow(held, t, n, span))
            yield pdf.drop(columns=["__tm_block", "__tm_t"]).assign(allowed=out)

    dealt = rows.repartition(key, "__tm_block").sortWithinPartitions(key, "__tm_block", ts, tie)
    return dealt.mapInPandas(step, calls.select("*", F.lit(True).alias("allowed")).schema)


def _allow(held: deque, t: int, n: int, span: int) -> bool:
    """Whether a call at t may pass; ``held`` keeps the allowed calls of the last ``span``."""
    while held and t - held[0] >= span:
        held.popleft()
    if len(held) >= n:
        return False
    held.append(t)
    return True


def throttle(calls: DataFrame, key: str, ts: str, tie: str, seconds: int = 5) -> DataFrame:
    """Each call with ``allowed``: none of its key was allowed in the ``seconds`` before it."""
    return sliding_limit(calls, key, ts, 1, seconds, tie)


def stream_throttle(calls: DataFrame, key: str, ts: str, tie: str, seconds: int = 5) -> DataFrame:
    """The throttle on a stream: key, ts, tie and allowed. Calls are taken batch by batch, in time order within one; the state is a key's last allowed time.

    key and tie are longs. A call older than the last allowed one is judged against it like a call at the same time.
    """
    schema = f"{key} long, {ts} timestamp, {tie} long, allowed boolean"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        rows["allowed"] = [_allow(held, t.as_unit("us")._value, 1, seconds * 1_000_000) for t in rows[ts]]
        state.update((held[-1],))
        yield rows[[key, ts, tie, "allowed"]]

    return calls.select(key, ts, tie).groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def stream_quota(calls: DataFrame, key: str, ts: str) -> DataFrame:
    """Calls per key and UTC day on a stream; a day closes an hour after its end."""
    return calls.withWatermark(ts, "1 hour").groupBy(F.window(ts, "1 day"), key).agg(F.count("*").alias("calls"))
