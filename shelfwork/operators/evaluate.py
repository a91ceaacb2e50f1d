"""Evaluation: confusion, class reports, comparisons and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from .labels import argmax


def softmax(values: str | Column) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda t, x: t + x)
    return F.transform(powers, lambda x: x / total)


def predictions(df: DataFrame, logits: str) -> DataFrame:
    """Predicted class id and its probability."""
    scored = df.withColumn("probabilities", softmax(logits))
    return scored.withColumns(
        {"predicted": argmax("probabilities"), "confidence": F.array_max("probabilities")}
    )


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Counts of all pairs of true and predicted class, zeros included."""
    counts = df.groupBy(F.col(true).alias("true_class"), F.col(predicted).alias("pred_class")).agg(F.count("*").alias("n"))
    # the classes are few: one row per class and pair of classes from here on
    both = counts.select(F.explode(F.array("true_class", "pred_class")).alias("c")).distinct()
    classes = both.agg(F.sort_array(F.collect_list("c")).alias("all"))
    grid = classes.select("all", F.explode("all").alias("true_class")).select("true_class", F.explode("all").alias("pred_class"))
    return grid.join(counts, ["true_class", "pred_class"], "left").select("true_class", "pred_class", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_normalized(matrix: DataFrame, digits: int = 2) -> DataFrame:
    """Shares per true class."""
    share = F.col("n") / F.sum("n").over(W.partitionBy("true_class"))
    return matrix.select("true_class", "pred_class", F.round(F.coalesce(share, F.lit(0.0)), digits).alias("share"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    hit = F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)
    sides = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("true_class").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
                F.struct(F.col("pred_class").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("tp", "predicted"), zero)
    recall = F.coalesce(F.try_divide("tp", "support"), zero)
    rated = sums.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return rated.select("class", "precision", "recall", f1.alias("f1"), "support")


def report_averages(matrix: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages, one row."""
    accuracy = matrix.agg(
        (F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a")
    )
    aggs = []
    for c in ("precision", "recall", "f1"):
        aggs += [
            F.avg(c).alias(f"macro_{c}"),
            (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}"),
        ]
    report = class_report(matrix).agg(*aggs, F.sum("support").alias("support"))
    return report.withColumn("accuracy", accuracy.scalar())


def confused_pairs(matrix: DataFrame, best: int = 10) -> DataFrame:
    """The most frequent confusions."""
    wrong = matrix.where((F.col("true_class") != F.col("pred_class")) & (F.col("n") > 0))
    return wrong.orderBy(F.desc("n"), F.desc("true_class"), F.desc("pred_class")).limit(best)


def best_and_worst(report: DataFrame, best: int = 3) -> DataFrame:
    """Strongest and weakest classes by F1."""
    up = F.row_number().over(W.orderBy(F.desc("f1"), "class"))  # one row per class
    down = F.row_number().over(W.orderBy("f1", "class"))
    ranked = report.withColumns({"best_rank": up, "worst_rank": down})
    return ranked.where((F.col("best_rank") <= best) | (F.col("worst_rank") <= best)).select(
        "class", "f1", "best_rank", "worst_rank"
    )


def compare_reports(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("val", "test")) -> DataFrame:
    """F1 of both reports per class and the difference."""
    a = first.select("class", F.col("f1").alias(f"{names[0]}_f1"))
    b = second.select("class", F.col("f1").alias(f"{names[1]}_f1"))
    return a.join(b, "class").withColumn("difference", F.col(f"{names[1]}_f1") - F.col(f"{names[0]}_f1"))


def _bands(value: Column, bands, rest: str, inclusive: bool) -> Column:
    out = None
    for limit, name in bands:
        hit = value >= limit if inclusive else value > limit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(rest)


def gap_verdict(gap: str | Column) -> Column:
    return _bands(F.col(gap) if isinstance(gap, str) else gap, fixed.GAP_BANDS, "good", False)


def accuracy_verdict(accuracy: str | Column) -> Column:
    return _bands(F.col(accuracy) if isinstance(accuracy, str) else accuracy, fixed.ACCURACY_BANDS, "baseline", True)


def accuracy(df: DataFrame, true: str, predicted: str) -> DataFrame:
    right = F.when(F.col(true) == F.col(predicted), 1.0).otherwise(0.0)
    return df.agg(F.avg(right).alias("accuracy"), F.count_distinct(predicted).alias("predicted_classes"))


def accuracy_by_split(df: DataFrame, split: str, true: str, predicted: str) -> DataFrame:
    """Accuracy of train, validation and test, and the differences between them, one row."""
    right = F.when(F.col(true) == F.col(predicted), 1.0).otherwise(0.0)
    parts = [F.avg(F.when(F.col(split) == s, right)).alias(s) for s in ("train", "val", "test")]
    return df.agg(*parts).withColumns(
        {"val_minus_train": F.col("val") - F.col("train"), "test_minus_val": F.col("test") - F.col("val")}
    )


def upsert_latest(stored: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Stored and new results, the latest per key."""
    rows = stored.unionByName(new)
    rest = [c for c in rows.columns if c not in (key, version)]
    latest = F.max(F.struct(version, *rest)).alias("_latest")
    return rows.groupBy(key).agg(latest).select(key, "_latest.*").select(*rows.columns)


def leaderboard(results: DataFrame, key: str, score: str, minutes: str | None = None) -> DataFrame:
    """Results with ``place`` from 1, best score first, ties by key; with ``minutes`` also the score per minute.

    One row per model is expected: the whole board is ranked in one task. Null scores come last.
    """
    placed = results.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last(score), key)))
    if minutes is None:
        return placed
    per_minute = F.when(F.col(minutes) > 0, F.col(score) / F.col(minutes))
    return placed.withColumn(f"{score}_per_minute", per_minute)


def head_rows(df: DataFrame, by: str, key: str, n: int = 100) -> DataFrame:
    """The first ``n`` rows of each value of ``by``, in key order; only keys are ranked, ``n`` from each task at most."""
    first = F.row_number().over(W.partitionBy(by).orderBy(key))
    return df.withColumn("_row", first).where(F.col("_row") <= n).drop("_row")


def remaining(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Planned keys that are not done."""
    return planned.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def class_set_difference(first: DataFrame, second: DataFrame, label: str) -> DataFrame:
    """Classes that only one of two tables has; empty when the sets are equal."""
    a, b = first.select(label).distinct(), second.select(label).distinct()
    only_first = a.join(b, label, "left_anti").withColumn("side", F.lit("first"))
    only_second = b.join(a, label, "left_anti").withColumn("side", F.lit("second"))
    return only_first.unionByName(only_second)


def enrichment_audit(df: DataFrame, original: str, enriched: str, empty: str = "[EMPTY]", by: Sequence[str] = ()) -> DataFrame:
    """Rows, enriched, empty, unchanged and really changed."""
    new = F.col(enriched)
    audit = df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count(enriched).alias("not_null"),
        F.count_if(new == empty).alias("empty"),
        F.count_if(new == F.col(original)).alias("identical"),
    )
    return audit.withColumn("changed", F.col("not_null") - F.col("empty") - F.col("identical"))


def is_enriched(original: str, enriched: str, empty: str = "[EMPTY]") -> Column:
    new = F.col(enriched)
    return F.coalesce(new.isNotNull() & (new != empty) & (new != F.col(original)), F.lit(False))


def resume_point(df: DataFrame, key: str, valid: Column) -> DataFrame:
    """Number of rows before the first invalid row, in key order."""
    first_bad = df.where(~valid).agg(F.min(key))
    bad = first_bad.scalar()
    before = F.when(bad.isNull() | (F.col(key) < bad), 1).otherwise(0)
    return df.agg(F.coalesce(F.sum(before), F.lit(0)).cast("bigint").alias("resume_at"))


def throughput(df: DataFrame, group: str, seconds: str, rows: str, extrapolate_to: int) -> DataFrame:
    """Time and rate per group, and the time a table of another size would take."""
    sums = df.groupBy(group).agg(F.sum(seconds).alias("total_time"), F.sum(rows).alias("rows"))
    rate = F.when(F.col("total_time") > 0, F.col("rows") / F.col("total_time")).otherwise(0.0)
    per_row = F.when(F.col("rows") > 0, F.col("total_time") / F.col("rows")).otherwise(0.0)
    timed = sums.withColumns({"avg_time_per_row": per_row, "rows_per_second": rate})
    return timed.withColumn("expected_hours", F.col("avg_time_per_row") * extrapolate_to / 3600)
