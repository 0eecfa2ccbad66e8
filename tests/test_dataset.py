"""Fitting a classifier on the training part, and ranges of labels."""

import random

from pyspark.sql import functions as F

from voxtable.operators import dataset, metrics


def test_classifier_learns_and_predicts_the_other_part(spark):
    draw = random.Random(3)
    rows = [(i, i % 3, [draw.gauss(3.0 * (k == i % 3), 0.5) for k in range(3)]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label long, vec array<double>")
    split = dataset.stratified_split(df, "id", "label", 0.25)
    pred = dataset.train_classifier(split, "vec", "label", "id")
    held = {r["id"] for r in split.where("part = 'validation'").collect()}
    got = pred.collect()
    assert {r["id"] for r in got} == held and len(held) == 60
    assert all(r["y_true"] == r["id"] % 3 for r in got)
    assert metrics.score_summary(pred).first()["accuracy"] > 0.95


def test_label_ids_whatever_labels_begin_with(spark):
    names = [f"same prefix {i:04d}" for i in range(500)] + ["é", "Z", "a"]
    rows = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "name string")
    got = {r["name"]: r["label_id"] for r in dataset.label_ids(rows, "name").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))} | {None: None}
    report = metrics.class_report(spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "y_true int, y_pred int"), ["a", "b", "c"])
    assert {r["class"]: r["f1"] for r in report.collect()}["micro avg"] == 2 / 3
    assert report.where(F.col("class") == "accuracy").count() == 0
