"""Evaluation of predictions.  Everything derives from the confusion matrix, at most classes x classes rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ratio
from .quantiles import finite, quantiles


def pair_counts(df: DataFrame, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    return df.groupBy(F.col(true).cast("int").alias("true_id"), F.col(pred).cast("int").alias("pred_id")).agg(F.count(F.lit(1)).alias("n"))


def _ids(df: DataFrame, n_classes: int, name: str) -> DataFrame:
    return df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(name))


def confusion_matrix(df: DataFrame, n_classes: int, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """true_id, pred_id, n of all pairs of classes, zeros included."""
    grid = _ids(df, n_classes, "true_id").select("true_id", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("pred_id"))
    return grid.join(pair_counts(df, true, pred), ["true_id", "pred_id"], "left").select("true_id", "pred_id", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, n_classes: int, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """class_id, support, tp, fp, fn, tn, precision, recall, f1, fpr, fnr of every class; 0 for a zero denominator."""
    cells = confusion_matrix(df, n_classes, true, pred)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("true_id").alias("class_id"), F.col("n").alias("of"), F.lit(0).cast("long").alias("as"), F.when(F.col("true_id") == F.col("pred_id"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred_id").alias("class_id"), F.lit(0).cast("long").alias("of"), F.col("n").alias("as"), F.lit(0).cast("long").alias("tp")),
    )))
    sums = sides.groupBy("class_id").agg(F.sum("of").alias("support"), F.sum("as").alias("predicted"), F.sum("tp").alias("tp"))
    total = F.sum("support").over(Window.partitionBy())  # over the classes only
    counted = sums.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp"), "total": total}).withColumn("tn", F.col("total") - F.col("support") - F.col("fp"))
    rates = counted.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("support")), "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")), "fnr": ratio(F.col("fn"), F.col("support"))})
    rates = rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rates.select("class_id", "support", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", "fnr")


def summary(df: DataFrame, n_classes: int, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """One row: total, accuracy, macro and weighted precision, recall and F1."""
    rows = per_class(df, n_classes, true, pred)
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return rows.agg(
        F.sum("support").alias("total"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )


def threat_summary(df: DataFrame, true: str = "true_id", pred: str = "pred_id", benign: int = 0) -> DataFrame:
    """One row: threats against benign: detection rate, precision, false alarm rate."""
    t, p = F.col(true) != benign, F.col(pred) != benign
    counts = df.agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))
    return counts.select("tp", "fn", "fp", "tn", ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("detection_rate"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarm_rate"))


def row_percent(df: DataFrame, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """true_id, pred_id, n and its percentage of the true class's rows."""
    return pair_counts(df, true, pred).withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("true_id")))


def delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: a's metrics minus b's, rounded to four decimals; both have one row."""
    names = [c for c in a.columns if c in b.columns]
    both = a.select(F.struct(*names).alias("a")).crossJoin(b.select(F.struct(*names).alias("b")))
    return both.select(*[F.round(F.col(f"a.{c}") - F.col(f"b.{c}"), 4).alias(f"{c}_delta") for c in names])


def latency(df: DataFrame, seconds: str) -> DataFrame:
    """Mean, median and 99th percentile (interpolated) of the finite values in milliseconds; the percentiles are found by
    distributed selection when this is called."""
    x = finite(F.col(seconds))
    median, p99 = quantiles(df, {seconds: x}, [0.5, 0.99])[seconds]
    return df.agg((F.avg(x) * 1000).alias("mean_ms"), (F.lit(median).cast("double") * 1000).alias("median_ms"), (F.lit(p99).cast("double") * 1000).alias("p99_ms"))


def expected_matches(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """df with match, and whether all rows match."""
    marked = df.withColumn("match", F.col(expected).eqNullSafe(F.col(predicted)))
    return marked.crossJoin(F.broadcast(marked.agg(F.min("match").alias("all_match"))))  # one row


def rank_candidates(df: DataFrame, *by: str) -> DataFrame:
    """df with rank: by the given columns, largest first, then model."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*[F.desc(c) for c in by], "model")))


def best_model(df: DataFrame, by: str = "macro_f1") -> DataFrame:
    return df.agg(F.max_by("model", F.struct(F.col(by), F.col("model"))).alias("model"), F.max(by).alias(by))


def as_share(n: Column, over: Window) -> Column:
    return n / F.sum(n).over(over)
