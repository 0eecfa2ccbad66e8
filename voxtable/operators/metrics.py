"""Classification metrics and training history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Timeline, attach, carry


def class_counts(pred: DataFrame, n_classes: int | None = None) -> DataFrame:
    """True positives, support and predicted count per class.

    Classes are 0 .. n-1 if their number is given, else those occurring as truth or
    prediction.  Rows are pre-aggregated by (truth, prediction).
    """
    cells = pred.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    both = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("y_true").cast("long").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("y_pred").cast("long").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("tp"),
                ),
            )
        ).alias("x")
    ).select("x.*")
    counts = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    if n_classes is None:
        return counts
    classes = pred.sparkSession.range(n_classes).withColumnRenamed("id", "label")
    return classes.join(counts, "label", "left").na.fill(0)


def _scores(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p = ratio(F.col("tp"), F.col("predicted"))
    r = ratio(F.col("tp"), F.col("support"))
    f = ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def score_summary(pred: DataFrame, n_classes: int | None = None) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro, micro and weighted scores."""
    s = _scores(class_counts(pred, n_classes))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    support, hits = F.sum("support"), F.sum("tp")
    return s.agg(
        support.alias("n_samples"),
        safe(hits, support).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        safe(2 * hits, support + F.sum("predicted")).alias("micro_f1"),
        safe(F.sum(F.col("f1") * F.col("support")), support).alias("weighted_f1"),
    )


def class_report(pred: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy (as F1) and the plain and weighted averages.

    Where a class of ``names`` occurs in no row, the row called accuracy is the micro average, as it is then usually shown.
    """
    s = _scores(class_counts(pred, len(names) if names else None))
    label = F.col("label").cast("string")
    if names:
        label = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("label") + 1).cast("int"))
    rows = s.select(label.alias("class"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    weighted = lambda c: F.when(total > 0, F.sum(F.col(c) * F.col("support")) / total).otherwise(F.lit(0.0)).alias(c)
    macro = s.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    mean = s.agg(F.lit("weighted avg").alias("class"), *[weighted(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    share = F.when(total > 0, F.sum("tp") / total).otherwise(F.lit(0.0))
    whole = F.min(F.col("support") + F.col("predicted")) > 0
    none = F.lit(None).cast("double")
    overall = s.agg(
        F.when(whole, "accuracy").otherwise("micro avg").alias("class"), F.when(whole, none).otherwise(share).alias("precision"),
        F.when(whole, none).otherwise(share).alias("recall"), share.alias("f1"), total.alias("support"),
    )
    return rows.unionByName(overall).unionByName(macro).unionByName(mean)


def confusion_matrix(pred: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Dense counts of truth by prediction, zeros included, one row per cell."""
    cells = pred.groupBy(F.col("y_true").cast("long").alias("y_true"), F.col("y_pred").cast("long").alias("y_pred")).agg(F.count("*").alias("n"))
    labels = class_counts(pred, n_classes).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    grid = labels.select("labels", F.explode("labels").alias("y_true"))
    grid = grid.select("y_true", F.explode("labels").alias("y_pred"))
    return grid.join(cells, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def per_class_recall(pred: DataFrame, n_classes: int | None = None) -> DataFrame:
    """Support and recall per class; no recall without support."""
    c = class_counts(pred, n_classes)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    return c.select("label", "support", recall.alias("recall_on_class"))


def class_weights(rows: DataFrame, label: str, n_classes: int | None = None) -> DataFrame:
    """Inverse class frequency over its mean; an absent class counts as one row."""
    counts = rows.groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("n"))
    if n_classes is not None:
        counts = rows.sparkSession.range(n_classes).withColumnRenamed("id", "label").join(counts, "label", "left")
    inverse = counts.select("label", (F.lit(1.0) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("w"))
    listed = inverse.agg(F.avg("w").alias("mean"), F.collect_list(F.struct("label", "w")).alias("all"))
    return listed.select(F.inline("all"), "mean").select("label", (F.col("w") / F.col("mean")).alias("weight"))


def best_epoch(history: DataFrame, patience: int, chunk_rows: int = 4096) -> DataFrame:
    """The epoch a run keeps when it stops after ``patience`` epochs without improvement.

    ``history`` has ``run, epoch, accuracy, macro_f1``.  An epoch improves when its
    (accuracy, macro F1) is larger than every earlier one's.
    """
    tl = Timeline(("epoch",), F.floor(F.col("epoch") / chunk_rows), ("run",))
    score = F.struct("accuracy", "macro_f1")
    seen = carry(
        history,
        tl,
        {"nth": ("sum", F.lit(1).cast("long")), "top": ("max_before", score)},
        {"improved": F.col("top").isNull() | (score > F.col("top")), "last": ("last", F.when(F.col("improved"), F.col("nth")))},
    )
    stop = seen.filter(F.col("nth") - F.col("last") >= patience).groupBy("run").agg(F.min("nth").alias("stop"))
    run = attach(seen, stop, ("run",)).filter(F.col("stop").isNull() | (F.col("nth") <= F.col("stop")))
    return run.groupBy("run").agg(
        F.max_by(F.struct("epoch", "accuracy", "macro_f1"), F.when(F.col("improved"), F.col("nth"))).alias("b"),
        F.max("epoch").alias("last_epoch"),
    ).select("run", "b.epoch", "b.accuracy", "b.macro_f1", "last_epoch")


def metrics_report(pred: DataFrame, task: str, names: list[str] | None = None) -> DataFrame:
    """One row with summary, per-class report and confusion matrix as nested columns."""
    summary = score_summary(pred, len(names) if names else None)
    summary = summary.select(F.lit(task).alias("task"), F.struct("*").alias("summary"))
    report = class_report(pred, names).agg(F.array_sort(F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))).alias("report"))
    matrix = confusion_matrix(pred, len(names) if names else None).agg(F.array_sort(F.collect_list(F.struct("y_true", "y_pred", "n"))).alias("confusion"))
    tagged = summary.join(report.withColumn("task", F.lit(task)), "task")
    return tagged.join(matrix.withColumn("task", F.lit(task)), "task")


def merge_reports(*reports: DataFrame, version: str = "metrics_merged_v1") -> DataFrame:
    """Task reports as one record: a map from task to report, with its format tag."""
    rows = None
    for one in reports:
        rows = one if rows is None else rows.unionByName(one)
    entries = F.collect_list(F.struct("task", F.struct("summary", "report", "confusion").alias("metrics")))
    return rows.agg(F.lit(version).alias("format"), F.map_from_entries(F.array_sort(entries)).alias("tasks"))
