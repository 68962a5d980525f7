"""Circuit breakers and calls guarded by them; stores in flight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cache import fold

COOLDOWN = 5.0


@dataclass
class Breaker:
    """closed lets all calls through; a failure opens it; after the cooldown one call is let through on trial."""

    cooldown: float = COOLDOWN
    state: str = "closed"
    opened: float = 0.0

    def call(self, ts: float, ok: bool) -> tuple[bool, str]:
        """Whether the call was admitted, and the state after it. One admission for each call: the trial ends
        with its own call, so the half-open state lasts no longer than it."""
        if self.state == "open" and ts - self.opened < self.cooldown:
            return False, self.state
        if ok:
            self.state = "closed"
        else:
            self.state, self.opened = "open", ts
        return True, self.state


def breaker(calls: DataFrame, cooldown: float = COOLDOWN) -> DataFrame:
    """calls (child, seq, ts, ok) -> child, seq, admitted, state, in order of seq by child."""

    def step(b: Breaker, seq, ts, ok):
        return seq, *b.call(float(ts), bool(ok))

    return fold(calls, "child", ["seq", "ts", "ok"], lambda: Breaker(cooldown), "child long, seq long, admitted boolean, state string", step)


def guarded(calls: DataFrame, states: DataFrame, value: Column, miss: Column) -> DataFrame:
    """A rejected or failed call gives the miss value."""
    return calls.join(states, ["child", "seq"]).withColumn("result", F.when(F.col("admitted") & F.col("ok"), value).otherwise(miss))


def translate_regions(regions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Opaque region ids as each child knows them; null where a child hasn't registered one."""
    return regions.join(mapping, ["region", "child"], "left")


def store_tracking(events: DataFrame) -> DataFrame:
    """events (request, seq, kind enqueue, done, fail or finish) -> request, pending, finished, status: a request
    is done when it has finished and no store of it is in flight; failed stores keep a status."""
    count = lambda *k: F.count_if(F.col("kind").isin(*k))
    rows = events.groupBy("request").agg((count("enqueue") - count("done", "fail")).alias("pending"), (count("finish") > 0).alias("finished"), count("fail").alias("failed"))
    status = F.when(F.col("failed") > 0, "failed").when(F.col("finished") & (F.col("pending") <= 0), "done").otherwise("in_flight")
    return rows.withColumn("status", status)


def barrier(events: DataFrame) -> DataFrame:
    """events (barrier, done): open once all are done."""
    return events.groupBy("barrier").agg(F.bool_and("done").alias("open"), F.count(F.lit(1)).alias("waiting_for"))
