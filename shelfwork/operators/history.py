"""Training histories: means per epoch, early stopping, schedules, trials.

A history has one row per run and epoch. Batch rows are averaged per epoch
first, with map-side sums, so the folds below see a few dozen entries per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def epoch_means(df: DataFrame, run: str, epoch: str, metrics: dict[str, Column]) -> DataFrame:
    """Mean of every metric per epoch; null where an epoch has no value."""
    return df.groupBy(run, epoch).agg(*[F.avg(c).alias(n) for n, c in metrics.items()])


def weighted_epoch_means(df: DataFrame, run: str, epoch: str, loss: str, correct: str, size: str) -> DataFrame:
    """Loss and accuracy per epoch, weighted by batch size."""
    return df.groupBy(run, epoch).agg(
        (F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("loss"),
        (F.sum(correct) / F.sum(size)).alias("accuracy"),
    )


def numbered_epochs(df: DataFrame, run: str, order: str) -> DataFrame:
    """Epochs 1, 2, ... per run."""
    return df.withColumn("epoch", F.row_number().over(W.partitionBy(run).orderBy(order)))


def _folded(df: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct(F.col(epoch).alias("epoch"), F.col(score).alias("score"))))
    return df.groupBy(run).agg(entries.alias("h"))


def early_stopping(df: DataFrame, run: str, epoch: str, score: str, patience: int = 6, min_delta: float = 0.0) -> DataFrame:
    """Best score so far and the epoch at which patience runs out (null if never)."""
    nothing = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("wait"),
        F.lit(None).cast("int").alias("stop"),
    )

    def step(s, e):
        better = s["best"].isNull() | (e["score"] < s["best"] - min_delta)
        wait = F.when(better, F.when(s["best"].isNull(), s["wait"]).otherwise(F.lit(0))).otherwise(s["wait"] + 1)
        stop = F.when(~better & (wait >= patience), e["epoch"])
        moved = F.struct(
            F.when(better, e["score"]).otherwise(s["best"]).alias("best"), wait.alias("wait"), stop.alias("stop")
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    folded = _folded(df, run, epoch, score).withColumn("s", F.aggregate("h", nothing, step))
    return folded.select(
        run, F.col("s.best").alias("best"), F.col("s.stop").alias("stop_epoch"), F.size("h").alias("epochs")
    )


def best_epoch(df: DataFrame, run: str, epoch: str, score: str, mode: str = "min") -> DataFrame:
    """The first epoch with the best score."""
    signed = F.col(score) if mode == "min" else -F.col(score)
    best = F.min(F.struct(signed.alias("s"), F.col(epoch).alias("epoch"), F.col(score).alias("score")))
    return df.where(F.col(score).isNotNull()).groupBy(run).agg(best.alias("b")).select(
        run, F.col("b.epoch").alias("best_epoch"), F.col("b.score").alias("best_score")
    )


def stack_stages(first: DataFrame, second: DataFrame, run: str, epoch: str) -> DataFrame:
    """Two stages on one epoch axis: the second starts after the first."""
    length = first.groupBy(run).agg(F.max(epoch).alias("_n"))
    moved = second.join(length, run, "left").withColumn(epoch, F.col(epoch) + F.coalesce("_n", F.lit(0))).drop("_n")
    return first.withColumn("stage", F.lit(1)).unionByName(moved.withColumn("stage", F.lit(2)))


def learning_curves(stacked: DataFrame, run: str, epoch: str, metrics: list[str]) -> DataFrame:
    """Long form: one row per run, stage, epoch and metric."""
    return stacked.unpivot([run, "stage", epoch], metrics, "metric", "value")


def last_scores(df: DataFrame, trial: str, epoch: str, metrics: list[str]) -> DataFrame:
    """Last value of every metric per trial."""
    return df.groupBy(trial).agg(*[F.max_by(m, epoch).alias(m) for m in metrics])


def top_trials(scores: DataFrame, trial: str, score: str, k: int = 5) -> DataFrame:
    return scores.orderBy(F.desc(score), trial).limit(k)
