"""The life cycle of positions as a stream of observations and as a replay of a table: both give the same states."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "position_name string, ts timestamp, state string"


def advanced(held: tuple[str, int, float, list[float]], freq: float, confidence: float, sources: int) -> tuple[str, int, float, list[float]]:
    """M8, M9: state, periods, sum of frequencies and the last three of them after one more period.

    Spread (W5) is of the last two periods, decline (W6) of the last three; a position recovers (W7, W8) where its last two are over the mean of all so far.
    """
    state, n, total, last = held
    n, total, last = n + 1, total + freq, [*last[-2:], freq]
    top = max(last[-2:])
    calm = n >= 2 and (top == 0 or (top - min(last[-2:])) / top < 0.25)
    fall = n >= 2 and last[0] != 0 and (last[0] - last[-1]) / last[0] > 0.4
    risen = n >= 2 and min(last[-2:]) > total / n
    if state == "candidate" and confidence >= 0.6 and sources >= 2:
        state = "emerging"
    elif state == "emerging" and confidence >= 0.8 and calm and sources >= 2:
        state = "stable"
    elif state in ("emerging", "stable") and fall:
        state = "declining"
    elif state == "declining" and risen:
        state = "stable"
    return state, n, total, last


class LifeCycle(StatefulProcessor):
    """Holds a position's observations until the watermark has passed them, so that they are applied in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, n bigint, total double, last array<double>, done bigint")
        self.waiting = handle.getMapState("waiting", "at bigint", "freq double, confidence double, sources bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        now = self.held.get()
        done = now[4] if now else None
        for r in rows:
            at = int(r["at"])
            if done is not None and at <= done:
                continue  # later than the watermark allows
            new, old = (r["freq"], r["confidence"], r["sources"]), self.waiting.getValue((at,))
            if old is None:
                self.handle.registerTimer(at)
            if old is None or new > tuple(old):
                self.waiting.updateValue((at,), new)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        now = self.held.get()
        held, done = ((now[0], now[1], now[2], list(now[3])), now[4]) if now else (("candidate", 0, 0.0, []), None)
        due = sorted((at, tuple(seen)) for (at,), seen in self.waiting.iterator() if at <= passed)
        for at, (freq, confidence, sources) in due:
            held, done = advanced(held, freq, confidence, sources), at
            self.waiting.removeKey((at,))
            yield Row(position_name=key[0], at=at, state=held[0])
        if due:
            self.held.update((*held, done))

    def close(self) -> None:
        pass


def life_cycles(stream: DataFrame, late: str) -> DataFrame:
    """M8, M9 over a stream ``position_name, ts, freq, confidence, sources``: the state after every period, when the watermark has passed it.

    Observations may come in any order within ``late``; later ones are left out. Of several for one period the largest counts. State is a few numbers a position and what still waits, a timer
    each. The session's state store has to be RocksDB, as ``ROCKSDB`` names it.
    """
    rows = stream.withWatermark("ts", late).select("ts", F.unix_millis("ts").alias("at"), "position_name", F.col("freq").cast("double").alias("freq"), F.col("confidence").cast("double").alias("confidence"), F.col("sources").cast("long").alias("sources"))
    out = rows.groupBy("position_name").transformWithState(LifeCycle(), "position_name string, at long, state string", "append", "eventTime")
    return out.select("position_name", F.timestamp_millis("at").alias("ts"), "state")


def replayed(rows: DataFrame) -> DataFrame:
    """The same from a table: a fold over a position's periods in order, of which there are as many as its history is long."""
    one = rows.groupBy("position_name", F.unix_millis("ts").alias("at")).agg(F.max(F.struct(F.col("freq").cast("double").alias("freq"), F.col("confidence").cast("double").alias("confidence"), F.col("sources").cast("long").alias("sources"))).alias("o"))
    each = one.groupBy("position_name").agg(F.array_sort(F.collect_list(F.struct("at", "o.freq", "o.confidence", "o.sources"))).alias("h"))
    begin = F.struct(F.lit("candidate").alias("state"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("last"), F.array().cast("array<struct<at: bigint, state: string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n, total = a["n"] + 1, a["total"] + x["freq"]
        last = F.concat(F.when(F.size(a["last"]) <= 2, a["last"]).otherwise(F.slice(a["last"], -2, 2)), F.array(x["freq"]))
        two = F.when(F.size(last) <= 2, last).otherwise(F.slice(last, -2, 2))
        top, low, first = F.array_max(two), F.array_min(two), F.element_at(last, 1)
        calm = (n >= 2) & ((top == 0) | (F.try_divide(top - low, top) < 0.25))
        fall = (n >= 2) & F.coalesce(F.try_divide(first - x["freq"], first) > 0.4, F.lit(False))
        several = x["sources"] >= 2
        state = (
            F.when((a["state"] == "candidate") & (x["confidence"] >= 0.6) & several, "emerging")
            .when((a["state"] == "emerging") & (x["confidence"] >= 0.8) & calm & several, "stable")
            .when(a["state"].isin("emerging", "stable") & fall, "declining")
            .when((a["state"] == "declining") & (n >= 2) & (low > total / n), "stable")
            .otherwise(a["state"])
        )
        return F.struct(state.alias("state"), n.alias("n"), total.alias("total"), last.alias("last"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), state.alias("state")))).alias("out"))

    folded = each.select("position_name", F.inline(F.aggregate("h", begin, step, lambda a: a["out"])))
    return folded.select("position_name", F.timestamp_millis("at").alias("ts"), "state")
