"""Classification metrics from counts, with every error policy and zero rule as a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.ordered import running_sums

#: What a row counts as. unparsed: without a usable prediction; other: with a prediction for another target.
#: Each pair is (gold positive, gold negative); None leaves the row out.
POLICIES = {
    "strict": {"unparsed": ("fn", "fp"), "missing": ("fn", "fp"), "other": ("fn", "fp")},
    "lenient": {"unparsed": (None, None), "missing": ("fn", "tn"), "other": ("fn", "tn")},
    "joint": {"unparsed": ("fn", "tn"), "missing": ("fn", "tn"), "other": ("fn", "tn")},
    "relaxed": {"unparsed": ("fn", "fp"), "missing": ("fn", "fp"), "other": None},
    "general": {"unparsed": (None, None), "missing": ("fn", "tn"), "other": ("fn", "tn")},
}
CELLS = ("tp", "fp", "fn", "tn")


def outcome(gold: Column, predicted: Column, *, policy: str, parsed: Column | None = None, right_target: Column | None = None) -> Column:
    """tp, fp, fn, tn or NULL of one row; gold and predicted are boolean, predicted NULL where no flag was given."""
    rule = POLICIES[policy]
    by_gold = lambda pair: F.when(gold, F.lit(pair[0])).otherwise(F.lit(pair[1]))
    out = F.when(gold.isNull(), F.lit(None).cast("string"))
    if parsed is not None:
        out = out.when(~parsed, by_gold(rule["unparsed"]))
    if right_target is not None and rule["other"]:
        out = out.when(~F.coalesce(right_target, F.lit(False)), by_gold(rule["other"]))
    out = out.when(predicted.isNull(), by_gold(rule["missing"]))
    return out.when(gold & predicted, "tp").when(gold, "fn").when(predicted, "fp").otherwise("tn")


def confusion_counts(df: DataFrame, cell: Column, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count(F.when(cell == c, 1)).alias(c) for c in CELLS])


def ratio(a: Column, b: Column, zero: float | None = None) -> Column:
    """a / b; where b is 0, NULL or the number given."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if zero is None else F.coalesce(out, F.lit(zero))


def binary_metrics(counts: DataFrame, *, zero: float | None = None, f1_mode: str = "counts") -> DataFrame:
    """precision, recall, specificity, f1, balanced_accuracy and accuracy from tp, fp, fn, tn.

    f1_mode `counts` is 2tp / (2tp + fp + fn), 0 where only errors exist; `harmonic` is undefined where precision and
    recall are both 0.
    """
    tp, fp, fn, tn = (F.col(c) for c in CELLS)
    precision, recall, specificity = ratio(tp, tp + fp, zero), ratio(tp, tp + fn, zero), ratio(tn, tn + fp, zero)
    f1 = ratio(2 * tp, 2 * tp + fp + fn, zero) if f1_mode == "counts" else ratio(2 * precision * recall, precision + recall, zero)
    return counts.withColumns({
        "precision": precision, "recall": recall, "specificity": specificity, "f1": f1,
        "balanced_accuracy": (recall + specificity) / 2, "accuracy": ratio(tp + tn, tp + fp + fn + tn, zero),
    })


METRICS = ("precision", "recall", "specificity", "f1", "balanced_accuracy")


def macro(metrics: DataFrame, columns: Sequence[str] = METRICS, by: Sequence[str] = ()) -> DataFrame:
    """Means over the classes for which a metric is defined."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(f"macro_{c}") for c in columns])


def micro(counts: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    return binary_metrics(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in CELLS]), **options)


def confusion_matrix(df: DataFrame, gold: Column, predicted: Column, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Rows (gold, predicted, n) of all pairs of classes, 0 where none occurs; other values are left out."""
    seen = df.select(*by, gold.cast("int").alias("gold"), predicted.cast("int").alias("predicted")).groupBy(*by, "gold", "predicted").agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("gold"), F.lit(b).alias("predicted")) for a in classes for b in classes])
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(pairs).alias("c")).select(*by, "c.*")
    return grid.join(seen, [*by, "gold", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_metrics(matrix: DataFrame, by: Sequence[str] = (), labels: str = "fixed") -> DataFrame:
    """precision, recall and f1 (0 where undefined) and support of each class; `observed` leaves out classes that occur
    on neither side."""
    both = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit("g").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side"))))
    long = matrix.select(*by, "gold", "predicted", "n", both.alias("x")).select(*by, "gold", "predicted", "n", "x.*")
    agg = long.groupBy(*by, "label").agg(
        F.sum(F.when((F.col("side") == "g") & (F.col("gold") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "g", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("called"),
    )
    if labels == "observed":
        agg = agg.where("support + called > 0")
    tp, s, c = F.col("tp"), F.col("support"), F.col("called")
    return agg.withColumns({"precision": ratio(tp, c, 0.0), "recall": ratio(tp, s, 0.0), "f1": ratio(2 * tp, s + c, 0.0)})


def accuracy(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hit = F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.groupBy(*by).agg(F.sum("n").alias("n"), ratio(hit, F.sum("n")).alias("accuracy"))


def weighted_kappa(matrix: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Quadratic weighted kappa of a full matrix of classes 0 to k - 1; 0 where the expected disagreement is 0."""
    weight = F.pow(F.col("gold") - F.col("predicted"), 2) / float((k - 1) ** 2)
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = Window.partitionBy(*by, "gold")
    columns = Window.partitionBy(*by, "predicted")
    parts = matrix.withColumns({"__w": weight, "__r": F.sum("n").over(rows), "__c": F.sum("n").over(columns), "__n": F.sum("n").over(w)})
    sums = parts.groupBy(*by).agg(F.sum(F.col("__w") * F.col("n")).alias("o"), F.sum(F.col("__w") * F.col("__r") * F.col("__c") / F.col("__n")).alias("e"))
    return sums.select(*by, F.coalesce(1 - F.try_divide("o", "e"), F.lit(0.0)).alias("qwk"))


def harmonic_f1(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Harmonic mean of the classes' f1 that are above 0."""
    good = F.when(F.col("f1") > 0, 1 / F.col("f1"))
    return per_class.groupBy(*by).agg(ratio(F.count(good), F.sum(good)).alias("harmonic_f1"))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by ranks, ties getting their mean rank; NULL if a group has one class only.

    Works on the distinct scores of each group, so ties of any number are one row, and on ranges of them, so that no
    task has all of a group.
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ties = known.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("q"))
    placed = running_sums(ties, by, score, ["q"])
    sums = placed.groupBy(*by).agg(F.sum(F.col("p") * (2 * F.col("q_before") + F.col("q"))).alias("twice"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return sums.select(*by, "n_pos", "n_neg", ratio(F.col("twice"), 2 * F.col("n_pos") * F.col("n_neg")).alias("auc"))


def numeric_errors(df: DataFrame, gold: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and mean absolute percentage error over pairs of numbers (percentages where gold is not 0)."""
    gap = F.abs(predicted - gold)
    return df.groupBy(*by).agg(F.count(gap).alias("n"), F.avg(gap).alias("mae"), F.avg(F.when(gold != 0, gap / F.abs(gold))).alias("mape"))


def parse_rates(df: DataFrame, checks: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """The share of rows that pass each check."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in checks.items()])


def metrics_document(per_class: DataFrame, key: str, subsets: dict[str, Sequence[str]], columns: Sequence[str] = METRICS) -> DataFrame:
    """One row: n, a struct of macro means for each named subset of classes, and a map class → counts and metrics."""
    own = F.struct(*[F.col(c) for c in (*CELLS, *columns)])
    macros = []
    for name, classes in subsets.items():
        inside = F.col(key).isin(*classes)
        macros.append(F.struct(*[F.avg(F.when(inside, F.col(c))).alias(c) for c in columns]).alias(f"{name}_macro"))
    n = F.sum(sum((F.col(c) for c in CELLS[1:]), F.col(CELLS[0]))).alias("n")
    return per_class.agg(n, *macros, F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), own.alias("value"))))).alias("by_class"))
