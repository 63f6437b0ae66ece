"""Model-frame preparation, profiles and classification metrics.

All of these are SQL-expressible aggregates; the learning itself (encoding,
logistic regression, scoring) is in ``shipwatch.operators.learn``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

from shipwatch import fixed_values as fv
from shipwatch.functions import clean_text, parse_number
from shipwatch.operators.medians import exact_medians, median_map, median_table  # noqa: F401
from shipwatch.operators.schema_ops import require_columns, unpivoted

def check_target(df: DataFrame, target: str = fv.TARGET_COLUMN, also: list[Column] | None = None):
    """Fail when the target has nulls, unparsable text or classes other than 0/1.

    ``also``: aggregates to take in the same pass; the row with them is returned.
    """
    t = parse_number(target)
    row = df.agg(F.count_if(t.isNull()).alias("bad"),
                 F.count_if(t.isNotNull() & ~t.isin(0.0, 1.0)).alias("other"), *(also or [])).first()
    if row["bad"]:
        raise ValueError(f"target {target!r} has {row['bad']} missing or unparsable values")
    if row["other"]:
        raise ValueError(f"target {target!r} has {row['other']} values outside {{0, 1}}")
    return row


def checked_target(target: str = fv.TARGET_COLUMN, number: Column | None = None) -> Column:
    """The target (``number``, if it is parsed already) as 0/1; any other value fails the job that reads it."""
    t = parse_number(target) if number is None else number
    told = F.concat(F.lit(f"target {target!r} is not 0 or 1: "), F.coalesce(F.col(target).cast("string"), F.lit("missing")))
    return F.when(t.isin(0.0, 1.0), t.cast("int")).otherwise(F.raise_error(told).cast("int"))


def model_frame(df: DataFrame, key: str | None = "order_item_id", check: bool | str = True,
                medians: dict[str, float | None] | None = None) -> DataFrame:
    """Categorical features to trimmed text (missing/blank -> UNKNOWN),
    numeric features to double with missing values set to the exact median,
    target to int.

    ``check``: True counts the targets that are not 0/1 in a job of its own and
    fails at once with their number; ``"plan"`` checks every row in the plan
    itself, so the job that reads the frame fails at the first such row and
    nothing runs before it; False does not check. Medians that are not given
    are a scalar subquery of the plan.
    """
    staged = parsed_frame(df, key, check)
    if medians is None:
        found = median_map(df.select(*[number_of(df, c).alias(c) for c in fv.NUMERICAL_FEATURES]), fv.NUMERICAL_FEATURES)
        filled = {c: F.coalesce(c, F.try_element_at(found, F.lit(c)), F.lit(0.0)) for c in fv.NUMERICAL_FEATURES}
        return staged.withColumns(filled)
    return filled_frame(staged, medians)


def number_of(df: DataFrame, column: str) -> Column:
    """A numeric column as a finite double; text is parsed, what is no number is null."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, DoubleType):
        return F.when(F.abs(c) < float("inf"), c)
    return c.cast("double") if isinstance(kind, (IntegerType, LongType)) else parse_number(column)


def parsed_frame(df: DataFrame, key: str | None = "order_item_id", check: bool | str = True) -> DataFrame:
    """``model_frame`` with its missing numbers still null."""
    require_columns(df, fv.CATEGORICAL_FEATURES + fv.NUMERICAL_FEATURES + [fv.TARGET_COLUMN],
                    "model input")
    if check is True:
        check_target(df)
    cols = [key] if key else []
    cols += [clean_text(c, nan_is_missing=False).alias(c) for c in fv.CATEGORICAL_FEATURES]
    cols += [number_of(df, c).alias(c) for c in fv.NUMERICAL_FEATURES]
    target = number_of(df, fv.TARGET_COLUMN)
    target = checked_target(number=target) if check == "plan" else target.cast("int")
    return df.select(*cols, target.alias(fv.TARGET_COLUMN))


def filled_frame(parsed: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """``parsed_frame`` with its missing numbers set to the medians (0 for a column without one)."""
    return parsed.withColumns({c: F.coalesce(c, F.lit(0.0 if medians.get(c) is None else medians[c])) for c in fv.NUMERICAL_FEATURES})


def features_and_target(frame: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The feature table X and the target table y of a model frame (each with ``key`` if given).

    A frame that carries a leakage column (known only after delivery), or lacks
    a feature or the target, is refused.
    """
    leaked = [c for c in frame.columns if c.lower() in fv.LEAKAGE_COLUMNS]
    if leaked:
        raise ValueError(f"leakage columns in the model frame: {leaked}")
    features = fv.CATEGORICAL_FEATURES + fv.NUMERICAL_FEATURES
    require_columns(frame, [*features, fv.TARGET_COLUMN, *([key] if key else [])], "model frame")
    keys = [key] if key else []
    return frame.select(*keys, *features), frame.select(*keys, fv.TARGET_COLUMN)


def category_vocabulary(frame: DataFrame, top: int = fv.MAX_CATEGORY_OPTIONS) -> DataFrame:
    """Per categorical feature: values by frequency (top ``top``), default = most frequent.

    Unpivot -> (feature, value) counts (partial aggregate) -> rank per feature
    over the distinct values only.
    """
    tall = unpivoted(frame, fv.CATEGORICAL_FEATURES, "string", "value").na.drop()
    counts = tall.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("frequency"))
    w = Window.partitionBy("feature").orderBy(F.desc("frequency"), "value")
    ranked = counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)
    return ranked.withColumn("is_default", F.col("position") == 1)


def numeric_profile(frame: DataFrame) -> DataFrame:
    """Median (exact), min and max of each numeric feature, one row each; null without a value."""
    names = frame.sparkSession.createDataFrame([(c,) for c in fv.NUMERICAL_FEATURES], "feature string")
    return names.join(median_table(frame, fv.NUMERICAL_FEATURES), "feature", "left").select("feature", "median", "min", "max")


def class_balance(split: DataFrame, label: str = fv.TARGET_COLUMN) -> DataFrame:
    """Rows and positive rate overall and per split, from one grouped aggregate."""
    per = split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("pos"))
    total = per.agg(F.lit("total").alias("split"), F.sum("rows").alias("rows"), F.sum("pos").alias("pos"))
    both = per.unionByName(total)
    return both.select("split", "rows", (F.col("pos") / F.col("rows")).alias("positive_rate"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def classification_metrics(scored: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (0 when undefined)."""
    y, p = F.col(label), F.col(prediction)
    c = scored.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                   F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select(
        "tn", "fp", "fn", "tp",
        _safe_div(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, tp + fn).alias("recall"),
        _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows = real class 0/1, columns = predicted 0/1 counts (0 when absent)."""
    labels = scored.sparkSession.createDataFrame([(0,), (1,)], f"{label} int")
    counts = (scored.groupBy(label).pivot(prediction, [0, 1]).count()
              .withColumnsRenamed({"0": "pred_0", "1": "pred_1"}))
    return labels.join(counts, label, "left").select(
        F.col(label).cast("int").alias("label"),
        F.coalesce("pred_0", F.lit(0)).cast("bigint").alias("pred_0"),
        F.coalesce("pred_1", F.lit(0)).cast("bigint").alias("pred_1"))


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Five metrics as rows: metric, value, percent text."""
    stacked = metrics.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in fv.METRIC_NAMES if m in metrics.columns])).alias("kv")).select("kv.*")
    return stacked.withColumn("value_percent", F.concat(F.format_number(F.col("value") * 100, 2), F.lit("%")))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve; tied scores count one half.

    AUC = sum over negatives of (positives scored above + positives tied / 2),
    over P x N. Scores are grouped to distinct values, which are spread by
    range over the partitions; each partition's positives are summed, and a
    value's count of higher-scored positives is that of the partitions above
    plus a running sum inside its own. So neither skewed scores nor their
    number put them in one task; only one row per partition meets in one.
    Integer arithmetic throughout.
    """
    per = scored.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).cast("bigint").alias("p"),
        F.count_if(F.col(label) == 0).cast("bigint").alias("n"))
    # the range bounds are sampled: written down once, both readers see the same partitions
    per = per.repartitionByRange(F.desc("s")).withColumn("b", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    tot = per.groupBy("b").agg(F.sum("p").alias("bp"))
    above_w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("p_higher", F.coalesce(F.sum("bp").over(above_w), F.lit(0))).select("b", "p_higher")
    in_w = Window.partitionBy("b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    j = per.withColumn("p_inside", F.coalesce(F.sum("p").over(in_w), F.lit(0))).join(tot, "b")
    above = (F.col("p_higher") + F.col("p_inside")).cast("decimal(38,0)")
    twice = F.col("n").cast("decimal(38,0)") * (F.lit(2) * above + F.col("p"))
    row = j.agg(F.sum(twice), F.sum("p"), F.sum("n")).first()
    per.unpersist()
    double_area, p, n = (int(x or 0) for x in row)
    value = double_area / (2 * p * n) if p and n else None
    return scored.sparkSession.createDataFrame([(value, p, n)], "roc_auc double, positives bigint, negatives bigint")
