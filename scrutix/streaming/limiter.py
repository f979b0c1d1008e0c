"""Streaming twins: stateless scoring and a sliding-log rate limiter."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrutix.operators.scoring import score_text


def score_stream(stream: DataFrame, text_col: str = "text", profile_col: str | None = None) -> DataFrame:
    """The batch scorer on a stream: it has no state, so the same columns serve."""
    return score_text(stream, text_col, profile_col)


def admit(times: list[float], log: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Sequential fold: an event passes if fewer than ``limit`` accepted ones are within ``window``.

    Rejected events aren't logged, and only entries strictly older than the
    window leave the log.
    """
    kept, out = deque(log), []
    for t in times:
        while kept and kept[0] < t - window:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, list(kept)


def rate_limit(events: DataFrame, key: str = "user_id", time: str = "ts", order: str = "event_id", limit: int = 120, window: float = 60.0) -> DataFrame:
    """``(key, order, allowed)`` of a batch of events, in time order for each key; null is a key of its own.

    A key's log holds ``limit`` entries at most.  Rows of a key arrive sorted
    and in pieces, so a key with very many events takes time, not memory.
    """
    import pandas as pd

    def run(batches):
        log, current = [], ()
        for pdf in batches:
            out = []
            for k, part in pdf.groupby(key, sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if k != current:
                    log, current = [], k
                ok, log = admit(part["_t"].tolist(), log, limit, window)
                out.append(pd.DataFrame({key: part[key], order: part[order], "allowed": ok}))
            yield pd.concat(out) if out else pd.DataFrame({key: [], order: [], "allowed": []})

    # text keeps pandas from turning keys beside a null into floats
    t = events.select(F.col(key).cast("long").cast("string").alias(key), F.col(order).cast("long").alias(order), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("_t"))
    t = t.repartition(key).sortWithinPartitions(key, "_t", order)
    return t.mapInPandas(run, f"{key} string, {order} long, allowed boolean").withColumn(key, F.col(key).cast("long"))


def rate_limit_stream(events: DataFrame, key: str = "user_id", time: str = "ts", order: str = "event_id", limit: int = 120, window: float = 60.0) -> DataFrame:
    """The limiter on a stream, its log as keyed state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k, pdfs, state):
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values(["_t", order])
        ok, log = admit(rows["_t"].tolist(), log, limit, window)
        state.update((log,))
        yield pd.DataFrame({key: rows[key], order: rows[order], "allowed": ok})

    t = events.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("_t"))
    return t.groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, allowed boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)
