"""Structured Streaming twins of the stateful operators; each takes a streaming (or batch) DataFrame of events.

The queue and the controllers keep list and value state; they need a state store that can, such as RocksDB
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """A file stream of events, a few files a batch; ts becomes a timestamp, as watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def scores(events: DataFrame) -> DataFrame:
    """user_id, score_sum, n: sums that grow with the stream; two numbers of state a key."""
    return events.groupBy("user_id").agg(F.sum("value").alias("score_sum"), F.count("*").alias("n"))


def windowed_rates(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, mean of each window; state is dropped once the watermark passes."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return x.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def latest_in_slots(events: DataFrame, slots: int) -> DataFrame:
    """slot, event_id: a ring buffer in which the latest event of each slot stands."""
    return events.groupBy((F.col("event_id") % slots).alias("slot")).agg(F.max("event_id").alias("event_id"))


def exponential_means(events: DataFrame, beta: float) -> DataFrame:
    """user_id, ema, n: an exponential mean of values a user, in event order within each batch; one number of state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            ema = float(v) if ema is None else beta * ema + (1 - beta) * float(v)
            n += 1
        state.update((ema, n))
        yield pd.DataFrame({"user_id": [key[0]], "ema": [ema], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)


def best_so_far(events: DataFrame, patience: int) -> DataFrame:
    """user_id, best, wait, stop: a user's least value, how many values came since, and whether that is the patience.

    The twin of early_stop(), in event order within each batch; three numbers of state a key.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, wait, stop = state.get if state.exists else (float("inf"), 0, False)
        for v in pd.concat(list(frames)).sort_values(["ts", "event_id"])["value"]:
            best, wait = (float(v), 0) if v < best else (best, wait + 1)
            stop = stop or wait >= patience
        state.update((best, wait, stop))
        yield pd.DataFrame({"user_id": [key[0]], "best": [best], "wait": [wait], "stop": [stop]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, best double, wait long, stop boolean", "best double, wait long, stop boolean", "update", GroupStateTimeout.NoTimeout)


def bottom_k(events: DataFrame, k: int, seed: int, hash_of) -> DataFrame:
    """slot, event_id: a sample of up to k events, in each of k slots the one with the least hash.

    hash_of(column, seed) gives the hash. Merging two samples is taking the lesser in each slot, so the order in which
    events come, and how they are dealt to batches, doesn't matter; the state is k rows.
    """
    slot = F.pmod(hash_of("event_id", seed), F.lit(k)).alias("slot")
    return events.select(slot, F.struct(hash_of("event_id", seed).alias("h"), "event_id").alias("r")).groupBy("slot").agg(F.min("r").alias("r")).select("slot", "r.event_id")


class Fifo(StatefulProcessor):
    """The last `size` events of a key, in order; what is older is evicted. Each arrival takes the next slot around."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "event_id long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])["event_id"].tolist()
        n = self.count.get()[0] if self.count.exists() else 0
        kept = ([r[0] for r in self.items.get()] if self.items.exists() else []) + new
        self.items.put([(int(x),) for x in kept[-self.size :]])
        self.count.update((n + len(new),))
        out = [(key[0], i % self.size, i, int(x)) for i, x in enumerate(new, n)][-self.size :]
        yield pd.DataFrame(out, columns=["queue", "slot", "n", "event_id"])

    def close(self) -> None:
        pass


class Resets(StatefulProcessor):
    """The twin of momentum_resets(): what the last progress was, and how many epochs the cooldown still lasts."""

    def __init__(self, threshold: float, guard: float, tolerance: float, cooldown: int) -> None:
        self.threshold, self.guard, self.tolerance, self.cooldown = threshold, guard, tolerance, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "before double, wait int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, wait = self.state.get() if self.state.exists() else (None, 0)
        out = []
        for epoch, now in pd.concat(list(rows)).sort_values("epoch")[["epoch", "progress"]].itertuples(index=False):
            now = None if pd.isna(now) else float(now)
            wait = max(wait - 1, 0)
            fell = before is not None and now is not None and before >= self.threshold and now < self.threshold + self.guard and now - before <= -self.tolerance
            reset = fell and wait <= 0
            wait = self.cooldown if reset else wait
            before = now if now is not None and now >= 0 else None
            out.append((key[0], int(epoch), reset))
        self.state.update((before, wait))
        yield pd.DataFrame(out, columns=["run", "epoch", "reset"])

    def close(self) -> None:
        pass


class Progress(StatefulProcessor):
    """The twin of progress_controller(): an exponential mean and the weight that it drives."""

    def __init__(self, beta: float, low: float, high: float, step: float, start: float, hold=None, target=None, band=None) -> None:
        self.beta, self.low, self.high, self.step, self.start = beta, low, high, step, start
        self.hold, self.target, self.band = hold, target, band

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "ema double, w double")

    def aim(self, ema: float, rate: float) -> float:
        aim = self.low + (self.high - self.low) * (1 - ema)
        if self.hold is not None and ema >= self.hold[0]:
            aim = max(aim, self.hold[1])
        if self.target is not None:
            off = rate - self.target[0]
            aim += self.target[1] * (0.0 if abs(off) <= self.target[2] else off)
        if self.band is not None:
            least, most, dead, above, below = self.band
            aim += above * (rate - most - dead) if rate > most + dead else below * (rate - least + dead) if rate < least - dead else 0.0
        return aim

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ema, w = self.state.get() if self.state.exists() else (None, self.start)
        out = []
        for r in pd.concat(list(rows)).sort_values("epoch").itertuples(index=False):
            if pd.isna(r.progress):
                continue
            ema = float(r.progress) if ema is None else self.beta * ema + (1 - self.beta) * float(r.progress)
            move = max(-self.step, min(self.step, self.aim(ema, float(r.digit8_rate)) - w))
            w = max(self.low, min(self.high, w + move))
            out.append((key[0], int(r.epoch), ema, w))
        self.state.update((ema, w))
        yield pd.DataFrame(out, columns=["run", "epoch", "ema", "weight"])

    def close(self) -> None:
        pass


def fifo_queue(events: DataFrame, size: int, queue: str = "user_id") -> DataFrame:
    """queue, slot, n, event_id: the queue of each key as it fills; the row of a slot with the greatest n stands."""
    schema = "queue long, slot long, n long, event_id long"
    return events.groupBy(queue).transformWithStateInPandas(Fifo(size), schema, "Update", "None")


def queue_contents(events: DataFrame, size: int, queue: str = "user_id") -> DataFrame:
    """The batch operator: queue, slot, n, event_id of the last `size` events of each key."""
    by = Window.partitionBy(queue).orderBy("ts", "event_id")
    x = events.select(F.col(queue).alias("queue"), "event_id", (F.row_number().over(by) - 1).cast("long").alias("n"), F.count("*").over(Window.partitionBy(queue)).alias("_all"))
    return x.filter(F.col("n") >= F.col("_all") - size).select("queue", (F.col("n") % size).alias("slot"), "n", "event_id")


def reset_stream(epochs: DataFrame, *args) -> DataFrame:
    """run, epoch, reset of a stream of epochs (run, epoch, progress)."""
    return epochs.groupBy("run").transformWithStateInPandas(Resets(*args), "run long, epoch long, reset boolean", "Update", "None")


def progress_stream(epochs: DataFrame, *args, **kwargs) -> DataFrame:
    """run, epoch, ema, weight of a stream of epochs (run, epoch, progress, digit8_rate)."""
    return epochs.groupBy("run").transformWithStateInPandas(Progress(*args, **kwargs), "run long, epoch long, ema double, weight double", "Update", "None")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Processes all that is there into an in-memory table and returns it."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
