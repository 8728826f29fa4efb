"""Training-control analytics: schedules, stopping, checkpoint choice and stateful controllers over epoch tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def learning_rate(progress: Column, base: float, warmup: float, epochs: float, floor: float = 5e-6) -> Column:
    """Linear warm-up, then a cosine down to the floor."""
    span = max(epochs - warmup, 1e-8)
    return F.when(progress < warmup, base * progress / warmup).otherwise(floor + (base - floor) * 0.5 * (1 + F.cos(math.pi * (progress - warmup) / span)))


def accumulation_window(step: Column, batches: int, grad_steps: int) -> tuple[Column, Column]:
    """The size of a step's accumulation window and whether the step ends it."""
    start = F.floor(step / grad_steps) * grad_steps
    size = F.least(F.lit(grad_steps), batches - start)
    return size, step == start + size - 1


def early_stop(epochs: DataFrame, patience: int) -> DataFrame:
    """epoch, val_loss, best_so_far, best_epoch, stop: strict improvement resets the wait. One row an epoch."""
    past = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    x = epochs.withColumn("_prev", F.min("val_loss").over(past))
    x = x.withColumn("_better", F.col("_prev").isNull() | (F.col("val_loss") < F.col("_prev")))
    x = x.withColumns({"best_so_far": F.min("val_loss").over(upto), "best_epoch": F.max(F.when(F.col("_better"), F.col("epoch"))).over(upto)})
    return x.select("epoch", "val_loss", "best_so_far", "best_epoch", (F.col("epoch") - F.col("best_epoch") >= patience).alias("stop"))


def _folded(epochs: DataFrame, zero: Column, step, fields: str) -> DataFrame:
    """A row an epoch (epoch and fields) from a fold over the epochs in order; step gives the new state with `row`."""
    rows = epochs.agg(F.array_sort(F.collect_list(F.struct("epoch", *(c for c in epochs.columns if c != "epoch")))).alias("_e"))  # one row an epoch
    start = F.struct(zero.alias("s"), F.array().cast(f"array<struct<{fields}>>").alias("out"))

    def both(acc: Column, e: Column) -> Column:
        state, row = step(acc["s"], e)
        return F.struct(state.alias("s"), F.array_append(acc["out"], row).alias("out"))

    return rows.select(F.explode(F.aggregate("_e", start, both, lambda acc: acc["out"])).alias("r")).select("r.*")


def best_checkpoint(epochs: DataFrame, policy: str, digit8_most: float = 1.0, fallback: bool = True, tie: float = 1e-12) -> DataFrame:
    """epoch: the one whose checkpoint a policy keeps: val_loss, val_em, val_em_legal_integer or val_em_digit8.

    An epoch replaces the kept one if its score is strictly better, or equal within `tie` with a better second rate.
    Under val_em_digit8 only epochs at or under the rate qualify; until any was kept the first epoch is, by its loss
    (whose number then is the score to beat). No row if nothing qualifies.
    """
    if policy not in ("val_loss", "val_em", "val_em_legal_integer", "val_em_digit8"):
        raise ValueError(f"no such policy: {policy}")
    null = F.lit(None).cast("double")
    zero = F.struct(F.lit(math.inf if policy == "val_loss" else -math.inf).alias("score"), null.alias("second"), F.lit(-1).cast("long").alias("kept"))

    def step(s: Column, e: Column):
        em, loss = e["val_em"], e["val_loss"]
        even = F.abs(em - s["score"]) <= tie
        if policy == "val_loss":
            better, score, second = loss < s["score"], loss, null
        elif policy == "val_em":
            better, score, second = em > s["score"], em, null
        elif policy == "val_em_legal_integer":
            second = e["legal_rate"]
            better, score = (em > s["score"]) | (even & (s["second"].isNull() | (second > s["second"]))), em
        else:
            second, fits = e["digit8_rate"], e["digit8_rate"] <= digit8_most
            first = F.lit(fallback) & (s["kept"] < 0) & (loss < math.inf)
            better = F.when(fits, (em > s["score"]) | (even & (s["second"].isNull() | (second < s["second"])))).otherwise(first)
            score = F.when(fits, em).otherwise(loss)
        new = F.struct(score.alias("score"), second.alias("second"), e["epoch"].cast("long").alias("kept"))
        return F.when(better, new).otherwise(s), F.struct(e["epoch"].cast("long").alias("epoch"), better.alias("better"))

    # infinite scores make the first difference no number, which is no tie
    return _folded(epochs, zero, step, "epoch:bigint,better:boolean").filter("better").agg(F.max("epoch").alias("epoch")).filter("epoch IS NOT NULL")


def progress(em: Column, digit8: Column, single_digit: Column, intercept: float, coefficients: tuple[float, float, float], clip: tuple[float, float] = (0.0, 1.0)) -> Column:
    """The affine estimate of progress from three rates, clipped."""
    a, b, c = coefficients
    return F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), intercept + a * em + b * digit8 + c * single_digit))


def progress_controller(
    epochs: DataFrame, beta: float, low: float, high: float, step: float, start: float, hold: tuple[float, float] | None = None,
    target: tuple[float, float, float] | None = None, band: tuple[float, float, float, float, float] | None = None,
) -> DataFrame:
    """epoch, ema, weight of a table epoch, progress, digit8_rate: an exponential mean of progress drives a weight.

    hold: from which mean on the weight aimed at is at least what. target: a rate of eights, the gain of what lies off
    it, and a dead band. band: least and most rate, dead band, gains above and below. The weight moves by `step` an
    epoch at most and stays between low and high. Where progress is null the epoch changes nothing and gives no row.
    """
    zero = F.struct(F.lit(None).cast("double").alias("ema"), F.lit(float(start)).alias("w"))

    def update(s: Column, e: Column):
        ema = F.coalesce(beta * s["ema"] + (1 - beta) * e["progress"], e["progress"])
        aim = low + (high - low) * (1 - ema)
        if hold is not None:
            aim = F.when(ema >= hold[0], F.greatest(aim, F.lit(float(hold[1])))).otherwise(aim)
        if target is not None:
            off = e["digit8_rate"] - target[0]
            aim = aim + target[1] * F.when(F.abs(off) <= target[2], 0.0).otherwise(off)
        if band is not None:
            least, most, dead, above, below = band
            rate, upper, lower = e["digit8_rate"], most + dead, least - dead
            aim = aim + F.when(rate > upper, above * (rate - upper)).when(rate < lower, below * (rate - lower)).otherwise(0.0)
        w = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), s["w"] + F.greatest(F.lit(-step), F.least(F.lit(step), aim - s["w"]))))
        return F.struct(ema.alias("ema"), w.alias("w")), F.struct(e["epoch"].cast("long").alias("epoch"), F.round(ema, 6).alias("ema"), F.round(w, 6).alias("weight"))

    return _folded(epochs.filter("progress IS NOT NULL"), zero, update, "epoch:bigint,ema:double,weight:double")


def momentum_resets(epochs: DataFrame, threshold: float, guard: float, tolerance: float, cooldown: int) -> DataFrame:
    """epoch, reset of a table epoch, progress: a reset fires when progress, from the threshold or above, falls by at
    least the tolerance to under the threshold or into the guard band over it, and no reset came within the cooldown.

    A negative progress counts as none: the next epoch has nothing to fall from.
    """
    zero = F.struct(F.lit(None).cast("double").alias("before"), F.lit(0).alias("wait"))

    def step(s: Column, e: Column):
        now, wait = e["progress"], F.greatest(s["wait"] - 1, F.lit(0))
        fell = (s["before"] >= threshold) & (now < threshold + guard) & (now - s["before"] <= -tolerance)
        hit = F.coalesce(fell, F.lit(False)) & (wait <= 0)
        new = F.struct(F.when(now >= 0, now).alias("before"), F.when(hit, F.lit(cooldown)).otherwise(wait).alias("wait"))
        return new, F.struct(e["epoch"].cast("long").alias("epoch"), hit.alias("reset"))

    return _folded(epochs, zero, step, "epoch:bigint,reset:boolean")
