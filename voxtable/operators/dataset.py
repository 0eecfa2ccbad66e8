"""Preparing labelled datasets and fitting classifiers on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import class_weights
from .ordered import Timeline, attach, durable, number


def label_ids(rows: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """Dense ids of the sorted distinct labels; integer labels pass through.

    Distinct labels are ranked in ranges whose edges Spark samples, so that no task
    sorts all of them, whatever they begin with.
    """
    if rows.schema[label].dataType.typeName() in ("integer", "long", "short", "byte"):
        return rows.withColumn(out, F.col(label).cast("long"))
    names = rows.filter(F.col(label).isNotNull()).select(label).distinct()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as the ranges must be the same wherever they are read
    ranged = durable(names.repartitionByRange(parts, label).withColumn("__range", F.spark_partition_id()))
    ids = number(ranged, Timeline((label,), F.col("__range"), ()), out).drop("__range")
    return rows.join(ids.withColumn(out, F.col(out) - 1), label, "left")


def class_count(rows: DataFrame, label: str) -> DataFrame:
    return rows.agg(F.countDistinct(label).alias("n_classes"))


def stratified_split(rows: DataFrame, id_: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark a repeatable ``share`` of every class as validation.

    Rows of a class are ordered by a hash of id and seed; the first ones up to the
    share's count are validation.  Ranks are taken per hash range, so a dominant
    class is ranked in parallel.
    """
    mixed = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"))))
    tl = Timeline(("__h", id_), F.conv(F.substring("__h", 1, 3), 16, 10), (label,))
    ranked = number(mixed, tl, "__rank")
    total = rows.groupBy(label).agg(F.count("*").alias("__n"))
    ranked = attach(ranked, total, (label,))
    cut = F.bround(F.col("__n") * share)
    part = F.when(F.col("__rank") <= cut, F.lit("validation")).otherwise(F.lit("train"))
    return ranked.withColumn("part", part).drop("__h", "__rank", "__n")


def train_classifier(
    rows: DataFrame, features: str, label: str, id_: str, n_classes: int | None = None, max_iter: int = 30, reg: float = 0.01
) -> DataFrame:
    """Fit a class-weighted classifier on the training part and predict the validation part.

    ``rows`` carries ``part`` from :func:`stratified_split`.  Returns
    ``id, y_true, y_pred`` for the metrics operators.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    weights = class_weights(rows.filter("part = 'train'"), label, n_classes).withColumnRenamed("label", "__label")
    ready = rows.join(weights, F.col(label).cast("long") == F.col("__label")).select(
        F.col(id_).alias("id"), F.col(label).cast("double").alias("y"), "weight", "part",
        array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("x"),
    )
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=max_iter, regParam=reg).fit(
        ready.filter("part = 'train'")
    )
    return model.transform(ready.filter("part = 'validation'")).select(
        "id", F.col("y").cast("long").alias("y_true"), F.col("prediction").cast("long").alias("y_pred")
    )


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """The manifest from CSV files with a header; other columns are left out, a missing category or fold is null."""
    rows = spark.read.option("header", "true").option("escape", '"').csv(path)
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.select(
        "filename", F.col("target").cast("int").alias("target"), have("category").cast("string").alias("category"), have("fold").cast("int").alias("fold")
    )


def read_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose file exists; a target's category is the last one the manifest gives it.

    ``manifest`` has ``filename, target, category, fold`` and ``files`` a ``path`` column; of several paths with one file
    name the first in alphabetical order counts.
    """
    known = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path")
    known = known.groupBy("filename").agg(F.min("path").alias("path"))
    rows = manifest.select(
        "filename", F.col("target").cast("int").alias("target"),
        F.coalesce("category", F.col("target").cast("string")).alias("category"), F.coalesce(F.col("fold").cast("int"), F.lit(0)).alias("fold"),
    )
    return rows.join(known, "filename").select("path", "target", "category", "fold")


def class_names(manifest: DataFrame, order: str = "filename") -> DataFrame:
    """Category per target in target order; the manifest's last row wins."""
    last = manifest.groupBy(F.col("target").cast("int").alias("target")).agg(F.max_by(F.coalesce("category", F.col("target").cast("string")), order).alias("category"))
    return last.agg(F.transform(F.array_sort(F.collect_list(F.struct("target", "category"))), lambda x: x["category"]).alias("class_names"))


def label_from_filename(files: DataFrame, path: str = "path") -> DataFrame:
    """Emotion label 0..7 from names like ``03-01-05-...wav``; others are dropped."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "-")
    code = F.expr("try_cast(get(__parts, 2) as int)")
    cut = files.filter(name.endswith(".wav")).withColumn("__parts", parts).withColumn("__code", code)
    kept = cut.filter((F.size("__parts") >= 3) & (F.get("__parts", F.lit(0)) == "03") & F.col("__code").between(1, 8))
    return kept.select(path, (F.col("__code") - 1).cast("long").alias("label")).orderBy(path)
