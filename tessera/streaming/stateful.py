"""Streams of chunks, calls and accesses. State is held by stream, child or cache; within a micro-batch rows
are taken in order of seq, and a source must give a key's rows in order over batches.

Under a trigger that runs on, give `kept`: the state of a key goes after so many milliseconds without a
row for it. Of a stream that ended that is an empty mark against late chunks; of one that never ended,
its parts; of a child or cache, its standing. Such timeouts run batches without data, so a query with
the trigger availableNow would not end; without `kept` all state stays. Each micro-batch writes the
state of the keys that it has rows for, so a stream's parts are written again with every part that
comes; large values should come in few chunks for each batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.cache import RESULT, ByteLRU
from tessera.operators.health import COOLDOWN, Breaker


def _timeout(kept: int | None) -> str:
    return GroupStateTimeout.NoTimeout if kept is None else GroupStateTimeout.ProcessingTimeTimeout


def _keep(state: GroupState, value: tuple, kept: int | None) -> None:
    state.update(value)
    if kept is not None:
        state.setTimeoutDuration(kept)


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    held = list(frames)
    return pd.concat(held).sort_values("seq", kind="stable") if held else pd.DataFrame({"seq": []})


def assemble(chunks: DataFrame, kept: int | None = None) -> DataFrame:
    """(stream_id string, seq long, data binary, header string, is_last boolean) -> one row for each stream as
    its last chunk comes; chunks may come in any order, and a stream is whole when none before the last lacks."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        parts, header, last, done = pickle.loads(state.get[0]) if state.exists else ({}, None, None, False)
        for r in _ordered(frames).itertuples(index=False):
            if done:
                break
            parts[int(r.seq)] = bytes(r.data or b"")
            header = r.header if r.seq == 0 else header
            last = int(r.seq) if r.is_last and (last is None or r.seq < last) else last
        out = []
        if not done and last is not None and all(i in parts for i in range(last + 1)):
            out.append((key[0], header, b"".join(parts[i] for i in range(last + 1)), last + 1))
            parts, done = {}, True
        _keep(state, (pickle.dumps((parts, header, last, done) if not done else ({}, None, None, True)),), kept)
        yield pd.DataFrame(out, columns=["stream_id", "header", "data", "chunks"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, header string, data binary, chunks int", "state binary", "append", _timeout(kept))


def breaker(calls: DataFrame, cooldown: float = COOLDOWN, kept: int | None = None) -> DataFrame:
    """(child long, seq long, ts double, ok boolean) -> child, seq, admitted, state."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:  # after any cooldown: as good as new
            state.remove()
            return
        b = Breaker(cooldown, *state.get) if state.exists else Breaker(cooldown)
        rows = [(key[0], r.seq, *b.call(float(r.ts), bool(r.ok))) for r in _ordered(frames).itertuples(index=False)]
        _keep(state, (b.state, b.opened), kept and max(kept, int(cooldown * 2000)))
        yield pd.DataFrame(rows, columns=["child", "seq", "admitted", "state"])

    return calls.groupBy("child").applyInPandasWithState(run, "child long, seq long, admitted boolean, state string", "state string, opened double", "append", _timeout(kept))


def byte_lru(trace: DataFrame, capacity: int, bypass: bool = False, kept: int | None = None) -> DataFrame:
    """(cache string, seq long, op string, key string, size long) -> cache, seq, hit, evicted, used."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        lru = pickle.loads(state.get[0]) if state.exists else ByteLRU(capacity, bypass)
        rows = []
        for r in _ordered(frames).itertuples(index=False):
            hit, evicted = lru.access(r.op, r.key, int(r.size))
            rows.append((key[0], r.seq, hit, evicted, lru.used))
        _keep(state, (pickle.dumps(lru),), kept)
        yield pd.DataFrame(rows, columns=["cache", "seq", "hit", "evicted", "used"])

    return trace.groupBy("cache").applyInPandasWithState(run, RESULT, "state binary", "append", _timeout(kept))


def request_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(ts, op, status) -> counts by window; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "op", "status").agg(F.count(F.lit(1)).alias("requests"))
