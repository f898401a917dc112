"""Evaluation of predictions. One shuffle over the predictions; everything after it works on the
(classes x classes) table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.encode import MAX_CLASSES
from reviewloom.operators.bounded import bounded


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, labels: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Long form ``(*by, actual, predicted, n)``, zeros filled in. Labels default to those seen."""
    pairs = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    counts = pairs.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if labels is None:
        seen = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
        known = bounded(seen, MAX_CLASSES, "labels").agg(F.collect_list("label").alias("all")).scalar()
    else:
        known = F.array(*[F.lit(x) for x in labels])
    groups = counts.select(*by).distinct() if by else counts.agg(F.count(F.lit(1)).alias("_any"))
    cells = groups.select(*by, F.explode(known).alias("actual")).select(
        *by, "actual", F.explode(known).alias("predicted")
    )
    return cells.join(counts, [*by, "actual", "predicted"], "left").select(
        *by, "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def classification_report(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form ``(*by, label, metric, value)``: precision, recall, f1 and support per class,
    ``accuracy``, and the macro and weighted averages. An empty denominator gives 0."""
    by = list(by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("tp")),
    )
    per_class = (
        confusion.select(*by, F.inline(roles))
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("tp").alias("tp"))
        .withColumn("precision", F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)))
        .withColumn("recall", F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)))
        .withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("guessed") + F.col("support")), F.lit(0.0)))
    )

    def weighted(name: str):
        return F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support")), F.lit(0.0))

    def row(label, metric: str, value):
        name = F.lit(label) if isinstance(label, str) else label
        return F.struct(name.alias("label"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    names = ["precision", "recall", "f1"]
    class_rows = per_class.select(
        *by, F.inline(F.array(*[row(F.col("label"), m, F.col(m)) for m in [*names, "support"]]))
    )
    totals = per_class.groupBy(*by).agg(
        F.sum("support").alias("support"),
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[weighted(m).alias(f"weighted_{m}") for m in names],
    )
    summary = [row("accuracy", "accuracy", F.col("accuracy"))]
    for kind in ("macro", "weighted"):
        summary += [row(f"{kind} avg", m, F.col(f"{kind}_{m}")) for m in names]
        summary.append(row(f"{kind} avg", "support", F.col("support")))
    return class_rows.unionByName(totals.select(*by, F.inline(F.array(*summary))))


def model_registry(report: DataFrame, negative: str, neutral: str, by: str = "model_name") -> DataFrame:
    """One row per model: accuracy, macro F1, F1 of the negative and neutral class, active flag."""

    def pick(label: str, metric: str):
        return F.max(F.when((F.col("label") == label) & (F.col("metric") == metric), F.col("value")))

    return report.groupBy(by).agg(
        pick("accuracy", "accuracy").alias("accuracy"),
        pick("macro avg", "f1").alias("macro_f1"),
        pick(negative, "f1").alias("f1_negative"),
        pick(neutral, "f1").alias("f1_neutral"),
        F.lit(True).alias("is_active"),
    )


def compare_scenarios(reports: Mapping[str, DataFrame], classes: Sequence[str]) -> DataFrame:
    """Wide comparison, one row per scenario: accuracy, macro F1, and F1 and recall of ``classes``."""
    tagged = [frame.withColumn("scenario", F.lit(name)) for name, frame in reports.items()]
    everything = tagged[0]
    for frame in tagged[1:]:
        everything = everything.unionByName(frame)
    wanted = ["accuracy:accuracy", "macro avg:f1"] + [f"{c}:{m}" for c in classes for m in ("f1", "recall")]
    names = ["accuracy", "macro_f1"] + [f"{m}_{c}" for c in classes for m in ("f1", "recall")]
    pivoted = (
        everything.withColumn("_key", F.concat_ws(":", "label", "metric"))
        .groupBy("scenario")
        .pivot("_key", wanted)
        .agg(F.max("value"))
    )
    return pivoted.select("scenario", *[F.col(f"`{w}`").alias(n) for w, n in zip(wanted, names)])
