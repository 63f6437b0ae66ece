"""Late-delivery risk model: encode, fit with pyspark.ml, score by SQL, explain.

Encoding follows "one-hot with a minimum frequency": category values seen
fewer than ``min_frequency`` times in training share one slot, and so do
values never seen in training. The encoder is a table of slots that rows are
joined with (``encoding``); no vocabulary passes the driver. When a feature
had no rare values its shared slot has no training rows, its coefficient stays
0 under the L2 penalty, and unseen values then contribute nothing, as an
all-zero encoding would.

The fitted model is a table of terms: a coefficient per slot, per number and
for the intercept. Scoring joins rows with it and adds up (``score_by_terms``);
the pyspark.ml stages are kept beside it and give the same probabilities.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StructType

from shipwatch import fixed_values as fv
from shipwatch.functions import parse_number
from shipwatch.operators import model as mdl
from shipwatch.operators.encoding import indexed_slots, sent_if_few, slot_column, with_slots
from shipwatch.operators.medians import exact_medians, median_table
from shipwatch.operators.metrics import combine_one_row
from shipwatch.operators.ranking import global_rank
from shipwatch.operators.sample import class_quotas, hash_limits, is_kept, seeded_hash
from shipwatch.operators.schema_ops import unpivoted
from shipwatch.session import shared_path
from shipwatch.sources.committed import Marks, Store

INFREQUENT = "__infrequent__"
CAT = fv.CATEGORICAL_FEATURES
NUM = fv.NUMERICAL_FEATURES


def value_counts(train: DataFrame) -> DataFrame:
    """(feature, value, n) of every categorical feature: one partial aggregate."""
    tall = unpivoted(train, CAT, "string", "value")
    return tall.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def encoder_slots(train: DataFrame, min_frequency: int = fv.MIN_CATEGORY_FREQUENCY) -> DataFrame:
    """The encoder as a table: (feature, value, n, slot) of every slot.

    A value seen at least ``min_frequency`` times has a slot of its own, in
    value order; all rarer values of a feature share its last slot (value
    null), which a feature without rare values has too, with n = 0.
    """
    counts = value_counts(train)
    frequent = counts.where(F.col("n") >= min_frequency).withColumn(
        "slot", F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1)
    spare = F.explode(F.array(*[F.lit(c) for c in CAT])).alias("feature")
    rare = (counts.where(F.col("n") < min_frequency).groupBy("feature").agg(F.sum("n").alias("n"))
            .unionByName(train.sparkSession.range(1).select(spare, F.lit(0).cast("bigint").alias("n")))
            .groupBy("feature").agg(F.sum("n").alias("n")))
    width = frequent.groupBy("feature").agg(F.count(F.lit(1)).cast("int").alias("width"))
    rare = rare.join(width, "feature", "left").select(
        "feature", F.lit(None).cast("string").alias("value"), "n", F.coalesce("width", F.lit(0)).alias("slot"))
    return frequent.select("feature", "value", "n", F.col("slot").cast("int").alias("slot")).unionByName(rare)


def scaler_constants(train: DataFrame) -> DataFrame:
    """(feature, mean, deviation): population values, a zero deviation as 1."""
    tall = unpivoted(train, NUM, "double", "v")
    return tall.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("s")).select(
        "feature", "mean", F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)).alias("deviation"))


def class_weights(train: DataFrame, label: str = fv.TARGET_COLUMN) -> DataFrame:
    """(label, rows, class_weight): n / (2 x rows of the class)."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    n = train.agg(F.count(F.lit(1))).scalar()
    return per.select(label, "rows", (n / (F.lit(2) * F.col("rows"))).cast("double").alias("class_weight"))


def training_figures(train: DataFrame, label: str = fv.TARGET_COLUMN) -> Row:
    """Rows, late rows, and each number's mean and population deviation: one aggregate."""
    return train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("late"),
                     *[x for c in NUM for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).first()


def scales(figures: Row) -> dict[str, tuple[float, float]]:
    """(mean, deviation) of each number; a zero deviation as 1."""
    found = {c: (float(figures[f"{c}__m"] or 0.0), float(figures[f"{c}__s"] or 0.0)) for c in NUM}
    return {c: (m, sd if sd > 0.0 else 1.0) for c, (m, sd) in found.items()}


def population_scaler(train: DataFrame, figures: Row | None = None) -> SQLTransformer:
    """Zero mean, unit population variance for the numeric features.

    Mean and population standard deviation come from one aggregate over the
    training rows (``figures``, if it was taken already); a zero deviation
    scales by 1. The fitted constants live in a SQL stage, so the step is saved
    and loaded with the model.
    """
    figures = figures or training_figures(train)
    parts = [f"(`{c}` - CAST('{m!r}' AS DOUBLE)) / CAST('{sd!r}' AS DOUBLE) AS `numerical__{c}`" for c, (m, sd) in scales(figures).items()]
    return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")


def balanced_weights(train: DataFrame, label: str = fv.TARGET_COLUMN, figures: Row | None = None) -> DataFrame:
    """weight = n / (2 x n_class)."""
    figures = figures or training_figures(train, label)
    n, late = figures["n"], figures["late"]
    late_weight, other_weight = (F.lit(n / (2 * k) if k else None).cast("double") for k in (late, n - late))
    return train.withColumn("class_weight", F.when(F.col(label) == 1, late_weight).otherwise(other_weight))


TERMS = "kind string, feature string, value string, slot int, index int, coefficient double, mean double, deviation double"


class LateRiskModel:
    """The fitted model: its table of terms (``TERMS``) and the pyspark.ml stages behind it."""

    def __init__(self, terms: DataFrame, pipeline: PipelineModel):
        self.terms, self.pipeline = terms, pipeline

    @property
    def stages(self) -> list:
        return self.pipeline.stages

    @property
    def slots(self) -> DataFrame:
        return self.terms.where("kind = 'category'").select("feature", "value", "slot")

    def save(self, path: str) -> str:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.pipeline.write().overwrite().save(f"{path}/stages")
        return path

    @staticmethod
    def load(path: str) -> "LateRiskModel":
        spark = SparkSession.getActiveSession()
        return LateRiskModel(spark.read.schema(TERMS).parquet(f"{path}/terms"), PipelineModel.load(f"{path}/stages"))


def with_indexes(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots as the doubles that pyspark.ml encodes."""
    return with_slots(rows, slots).withColumns({slot_column(c): F.col(slot_column(c)).cast("double") for c in CAT})


def fit_late_risk_model(train: DataFrame, max_iter: int = fv.MAX_ITERATIONS,
                        min_frequency: int = fv.MIN_CATEGORY_FREQUENCY, slots: DataFrame | None = None) -> LateRiskModel:
    """Fit scaler and balanced, L2-penalised logistic regression over the slot table.

    Penalty: the reference objective C * sum(w_i loss_i) + |b|^2 / 2 with
    C = 1 and balanced weights (sum w_i = n) equals Spark's
    mean-weighted-loss + regParam / 2 |b|^2 with regParam = 1 / n.
    """
    spark, label = train.sparkSession, fv.TARGET_COLUMN
    if slots is None:
        slots = encoder_slots(train, min_frequency).checkpoint()
    vec_cols = [f"{c}__vec" for c in CAT]
    last = {r["feature"]: r["last"] for r in slots.groupBy("feature").agg(F.max("slot").alias("last")).collect()}
    # the one-hot stage learns the number of slots from a row of the last ones: eleven numbers
    sizes = spark.range(1).select(*[F.lit(float(last[c])).alias(slot_column(c)) for c in CAT])
    ohe = OneHotEncoder(inputCols=[slot_column(c) for c in CAT], outputCols=vec_cols, dropLast=False).fit(sizes)
    figures = training_figures(train)
    scaler = population_scaler(train, figures)
    assembler = VectorAssembler(inputCols=vec_cols + [f"numerical__{c}" for c in NUM], outputCol="features")
    n = figures["n"]
    folder = f"{shared_path(spark, 'features')}-{uuid.uuid4().hex}"
    try:
        rows = feature_rows(train, slots, {c: last[c] + 1 for c in CAT}, scaler, figures, folder)
        lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="class_weight",
                                regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False,
                                maxIter=max_iter, tol=1e-4, fitIntercept=True, maxBlockSizeInMB=BLOCK_MEGABYTES,
                                probabilityCol="probability", rawPredictionCol="raw_score")
        lr_model = lr.fit(rows.coalesce(max(2 * spark.sparkContext.defaultParallelism, n * BLOCK_BYTES_A_ROW // PARTITION_BYTES)))
    finally:
        remove(spark, folder)
    return LateRiskModel(model_terms(slots, figures, lr_model), PipelineModel(stages=[ohe, scaler, assembler, lr_model]))


# What a training row takes in the fit's blocks (12 bytes a number that is not zero, and its
# label and weight), and how much of that one partition holds at most.
BLOCK_BYTES_A_ROW = 12 * (len(CAT) + len(NUM)) + 20
PARTITION_BYTES = 256 << 20
# The arrays of a block stay below half a megabyte, from which a JVM of small heap regions
# gives each regions of its own: those of larger blocks waste a third of the heap.
BLOCK_MEGABYTES = 0.7


def feature_rows(train: DataFrame, slots: DataFrame, widths: dict[str, int], scaler: SQLTransformer, figures: Row, folder: str) -> DataFrame:
    """(features, label, class_weight) of every training row, written once to ``folder``.

    The vectors are those of the one-hot and assembling stages, put together by
    SQL: a vector is stored as (type, size, indices, values). The stages name
    every slot in the metadata of their columns, which with a slot a product
    would go with each task and plan; these columns have none.
    """
    label, ones, at = fv.TARGET_COLUMN, [], 0
    for c in CAT:
        ones.append((F.lit(at) + F.col(slot_column(c))).cast("int"))
        at += widths[c]
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(at + len(NUM)).alias("size"),
                      F.array(*ones, *[F.lit(at + k) for k in range(len(NUM))]).alias("indices"),
                      F.array(*[F.lit(1.0) for _ in CAT], *[F.col(f"numerical__{c}") for c in NUM]).alias("values"))
    encoded = scaler.transform(with_slots(train.select(*CAT, *NUM, label), slots))
    weighted = balanced_weights(encoded, label, figures)
    weighted.select(vector.alias("features"), F.col(label).cast("double").alias(label), "class_weight").write.parquet(folder)
    schema = StructType().add("features", VectorUDT()).add(label, DoubleType()).add("class_weight", DoubleType())
    return train.sparkSession.read.schema(schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def model_terms(slots: DataFrame, figures: Row, fitted) -> DataFrame:
    """The coefficient vector met with the slots by index; the vector is the fit's own state."""
    spark, values = slots.sparkSession, fitted.coefficients.toArray()
    n_slots = len(values) - len(NUM)
    by_index = spark.createDataFrame(pa.table({"index": pa.array(np.arange(n_slots, dtype="int32")), "coefficient": pa.array(values[:n_slots])}))
    categories = indexed_slots(slots).join(by_index, "index").select(
        F.lit("category").alias("kind"), "feature", "value", "slot", "index", "coefficient",
        F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("deviation"))
    others = [("number", c, None, None, n_slots + k, float(values[n_slots + k]), m, sd) for k, (c, (m, sd)) in enumerate(scales(figures).items())]
    others.append(("intercept", "intercept", None, None, None, float(fitted.intercept), None, None))
    kinds = StructType.fromDDL(TERMS)
    others = spark.createDataFrame(pa.table({f.name: [r[k] for r in others] for k, f in enumerate(kinds)}), kinds)
    return categories.unionByName(others).checkpoint()


def share_terms(train: DataFrame, slots: DataFrame) -> DataFrame:
    """Terms straight from the shares of the training rows, without a fit.

    A slot's coefficient is the late share of its rows less one half (0 without
    rows); a number's is the mean of the late rows less the mean of all, in
    units of its range; the intercept is the late share less one half. A plain
    model to compare a fitted one with; its sums are exact.
    """
    y = F.col(fv.TARGET_COLUMN)
    tall = unpivoted(train.withColumn("y", y), CAT, "string", "value", ["y"])
    late = tall.groupBy("feature", "value").agg(F.sum("y").alias("late"), F.count(F.lit(1)).alias("n"))
    frequent = slots.where("value is not null").select("feature", "value", "slot")
    met = late.join(frequent, ["feature", "value"], "left").withColumn("value", F.when(F.col("slot").isNotNull(), F.col("value")))
    shares = met.groupBy("feature", "value").agg((F.sum("late") / F.sum("n") - F.lit(0.5)).alias("share"))
    key = [F.col("s.feature") == F.col("h.feature"), F.col("s.value").eqNullSafe(F.col("h.value"))]
    none = F.lit(None).cast("double")
    categories = indexed_slots(slots).alias("s").join(shares.alias("h"), key, "left").select(
        F.lit("category").alias("kind"), "s.feature", "s.value", "s.slot", "s.index", F.coalesce("share", F.lit(0.0)).alias("coefficient"),
        none.alias("mean"), none.alias("deviation"))
    exact, pos = {c: F.col(c).cast("decimal(38,6)") for c in NUM}, F.sum(y)
    n = F.count(F.lit(1))
    figures = train.agg(
        (pos / n - F.lit(0.5)).alias("intercept"),
        *[x for c in NUM for x in (
            (F.sum(exact[c]).cast("double") / n).alias(f"{c}__mean"),
            (F.sum(F.when(y == 1, exact[c])).cast("double") / pos).alias(f"{c}__late"),
            (F.max(c) - F.min(c)).alias(f"{c}__range"))])
    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    rows = [F.struct(F.lit("number").alias("kind"), F.lit(c).alias("feature"), none_text.alias("value"), none_int.alias("slot"), none_int.alias("index"),
                     ((F.col(f"{c}__late") - F.col(f"{c}__mean")) / F.nullif(F.col(f"{c}__range"), F.lit(0.0))).alias("coefficient"),
                     F.col(f"{c}__mean").alias("mean"), F.coalesce(F.nullif(F.col(f"{c}__range"), F.lit(0.0)), F.lit(1.0)).alias("deviation"))
            for c in NUM]
    rows.append(F.struct(F.lit("intercept").alias("kind"), F.lit("intercept").alias("feature"), none_text.alias("value"), none_int.alias("slot"),
                         none_int.alias("index"), F.coalesce("intercept", F.lit(0.0)).alias("coefficient"), none.alias("mean"), none.alias("deviation")))
    others = figures.select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("coefficient", F.coalesce("coefficient", F.lit(0.0)))
    return categories.unionByName(others).checkpoint()


def score_by_terms(terms: DataFrame, rows: DataFrame, missing: frozenset[str] = frozenset()) -> DataFrame:
    """Add ``late_delivery_risk_probability`` and the strict >0.5 class: a sparse dot product by joins.

    Each categorical feature meets its terms by an equi join on the value (one
    that is rare or unknown takes the shared term); the numbers, the shared
    terms and the intercept, some fifteen values, are one scalar subquery.
    Features in ``missing`` are the missing text in every row: their terms come
    the same way, as a join on a constant would have no key.
    """
    unknown = terms.where((F.col("kind") == "category") & (F.col("value") == fv.MISSING_TEXT)).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "coefficient")))).scalar()
    shared = terms.where("kind <> 'category' or value is null").agg(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("coefficient", "mean", "deviation"))))).scalar()

    def one(feature: str, part: str = "coefficient") -> Column:
        return F.element_at(shared, F.lit(feature))[part]

    out, total, sent = rows, one("intercept"), sent_if_few(terms)
    for c in CAT:
        if c in missing:
            total = total + F.coalesce(F.try_element_at(unknown, F.lit(c)), one(c), F.lit(0.0))
            continue
        mine = terms.where((F.col("kind") == "category") & (F.col("feature") == c) & F.col("value").isNotNull()).select(
            F.col("value").alias(f"{c}__value"), F.col("coefficient").alias(f"{c}__term"))
        out = out.join(sent(c, mine), F.col(c).cast("string") == F.col(f"{c}__value"), "left")
        total = total + F.coalesce(f"{c}__term", one(c), F.lit(0.0))
    for c in NUM:
        total = total + one(c) * ((F.col(c) - one(c, "mean")) / one(c, "deviation"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    return out.withColumn("late_delivery_risk_probability", p).select(
        *rows.columns, "late_delivery_risk_probability",
        (F.col("late_delivery_risk_probability") > F.lit(fv.DECISION_THRESHOLD)).cast("int").alias("late_delivery_risk_pred"))


def score(model: LateRiskModel, frame: DataFrame) -> DataFrame:
    """The same through the pyspark.ml stages; keeps their ``features`` vector."""
    out = model.pipeline.transform(with_indexes(frame.withColumns({c: F.col(c).cast("string") for c in CAT}), model.slots))
    p = vector_to_array("probability")[1]
    return out.withColumn("late_delivery_risk_probability", p) \
        .withColumn("late_delivery_risk_pred", (p > F.lit(fv.DECISION_THRESHOLD)).cast("int"))


def term_names(terms: DataFrame) -> DataFrame:
    """(index, feature, coefficient) of every input of the model, with the names that reports show."""
    name = F.when(F.col("kind") == "category", F.concat(F.lit("categorical__"), "feature", F.lit("_"), F.coalesce("value", F.lit(INFREQUENT)))) \
        .otherwise(F.concat(F.lit("numerical__"), "feature"))
    return terms.where("kind <> 'intercept'").select("index", name.alias("feature"), "coefficient")


def feature_names(model: LateRiskModel) -> list[str]:
    """The names in coefficient order, on the driver: to look at a model, no step of scoring or training."""
    return [r["feature"] for r in term_names(model.terms).orderBy("index").collect()]


def ranked_importance(coefficients: DataFrame) -> DataFrame:
    """(feature, coefficient) -> absolute importance and rank (ties by name)."""
    df = coefficients.select("feature", "coefficient", F.abs("coefficient").alias("abs_importance"))
    ranked = global_rank(df, F.desc("abs_importance"), F.col("feature"))
    return ranked.select(F.col("rank").cast("int").alias("rank"), "feature", "coefficient", "abs_importance")


def feature_importance(model: "LateRiskModel | DataFrame") -> DataFrame:
    """Coefficient per encoded feature (of a model or its terms), its absolute value and rank."""
    return ranked_importance(term_names(model if isinstance(model, DataFrame) else model.terms).drop("index"))


def top_features(importance: DataFrame, n: int = fv.TOP_FEATURES) -> DataFrame:
    """The ``n`` features with the largest absolute coefficient."""
    return importance.orderBy(F.desc("abs_importance"), "feature").limit(n)


def fill_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scoring input: missing category -> UNKNOWN, missing or bad number -> 0.0."""
    cols = {}
    for c in CAT:
        cols[c] = F.coalesce(F.col(c).cast("string"), F.lit(fv.MISSING_TEXT)) if c in scenarios.columns \
            else F.lit(fv.MISSING_TEXT)
    for c in NUM:
        cols[c] = F.coalesce(parse_number(c), F.lit(0.0)) if c in scenarios.columns \
            else F.lit(0.0)
    return scenarios.withColumns(cols)


def score_scenarios(model: "LateRiskModel | DataFrame", scenarios: DataFrame) -> DataFrame:
    """Probability and class (probability >= 0.5) for a table of scenarios, by the model's terms."""
    terms = model if isinstance(model, DataFrame) else model.terms
    # the filled values stand in the feature columns while scoring, the given ones in the result
    given = scenarios.select("*", F.struct(*[F.col(f"`{c}`") for c in scenarios.columns]).alias("_given"))
    scored = score_by_terms(terms, fill_scenarios(given), frozenset(CAT) - set(scenarios.columns))
    return scored.select("_given.*", "late_delivery_risk_probability",
                         (F.col("late_delivery_risk_probability") >= F.lit(fv.DECISION_THRESHOLD))
                         .cast("int").alias("late_delivery_risk_class"))


def run_counts(split: DataFrame) -> DataFrame:
    """Rows and positive rates of a split, in one row."""
    y = F.col(fv.TARGET_COLUMN)
    return split.groupBy().agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
        F.avg(y).alias("positive_class_rate_total"),
        F.avg(F.when(F.col("split") == "train", y)).alias("positive_class_rate_train"),
        F.avg(F.when(F.col("split") == "test", y)).alias("positive_class_rate_test"))


def rows_fingerprint(*tables: DataFrame, settings: str = "") -> str:
    """A name for the content of the tables, whatever the order and partitioning of their rows (one aggregate)."""
    def hashed(k: int, rows: DataFrame) -> DataFrame:
        # a null leaves such a hash as it is, so each value stands beside whether it is one
        values = [x for c in sorted(rows.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
        return rows.select(F.lit(k).alias("k"), F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))

    all_rows = hashed(0, tables[0])
    for k, t in enumerate(tables[1:], 1):
        all_rows = all_rows.unionAll(hashed(k, t))
    # the halves of a hash add up as longs, exactly, in tables of up to 2^31 rows; beyond, the job fails
    halves = [F.sum(x) for c in ("a", "b") for x in (F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))]
    found = all_rows.groupBy("k").agg(F.count(F.lit(1)), F.bit_xor("a"), F.bit_xor("b"), *halves).collect()
    told = [*sorted(map(tuple, found)), settings, fv.RANDOM_SEED, fv.TEST_FRACTION, fv.MIN_CATEGORY_FREQUENCY]
    return hashlib.sha256("|".join(map(str, told)).encode()).hexdigest()[:32]


class TrainingRun:
    """Everything one training produces, read from a store of committed results.

    The store is keyed by the fingerprint of the training rows, or of ``inputs``,
    the tables that they are made of by a fixed rule (named in ``rule``), which
    is read without the joins between them. The first run over some rows writes
    them once, parsed, then the model and what follows from it, and commits
    them; every later run over the same rows reads them. A run that breaks
    commits nothing.

    The medians and the hash limits of the split are some numbers, kept beside
    the parsed rows: what is filled and who is in the test part follow from
    them row by row, so the rows are not written again for either.
    """

    def __init__(self, orders: DataFrame, store: Store, key: str = "order_item_id",
                 inputs: list[DataFrame] | None = None, rule: str = ""):
        self.spark, self.store, self.key = orders.sparkSession, store, key
        self.orders = orders.select(key, *CAT, *NUM, fv.TARGET_COLUMN)
        self.name = rows_fingerprint(*(inputs or [self.orders]), settings=rule)

    # -- the split

    def _parsed(self, path: str) -> DataFrame:
        columns = [f"{self.key} {self.orders.schema[self.key].dataType.simpleString()}", *[f"{c} string" for c in CAT],
                   *[f"{c} double" for c in NUM], f"{fv.TARGET_COLUMN} int"]
        return self.spark.read.schema(", ".join(columns)).parquet(f"{path}/parsed")

    def _write_split(self, path: str) -> None:
        mdl.parsed_frame(self.orders, key=self.key, check="plan").write.parquet(f"{path}/parsed")
        rows = self._parsed(path)
        hashed = rows.select(fv.TARGET_COLUMN, seeded_hash(self.key).alias("_h"))
        limits = hash_limits(hashed, "_h", fv.TARGET_COLUMN, lambda sizes: class_quotas(sizes, fv.TEST_FRACTION))
        Marks(self.spark, path).write("figures", {"medians": exact_medians(rows, NUM), "limits": list(limits.items())})

    @property
    def split(self) -> DataFrame:
        path = self.store.get(f"split-{self.name}", self._write_split)
        figures = Marks(self.spark, path).read("figures")
        in_test = is_kept(seeded_hash(self.key), {c: h for c, h in figures["limits"]}, fv.TARGET_COLUMN)
        return mdl.filled_frame(self._parsed(path), figures["medians"]).withColumn("split", F.when(in_test, "test").otherwise("train"))

    @property
    def frame(self) -> DataFrame:
        return self.split.drop("split")

    @property
    def train(self) -> DataFrame:
        return self.split.where("split = 'train'").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.split.where("split = 'test'").drop("split")

    # -- the encoder and the model

    @property
    def slots(self) -> DataFrame:
        path = self.store.get(f"slots-{self.name}", lambda at: encoder_slots(self.train).write.parquet(f"{at}/slots"))
        return self.spark.read.schema("feature string, value string, n bigint, slot int").parquet(f"{path}/slots")

    def _write_model(self, path: str) -> None:
        model = fit_late_risk_model(self.train, slots=self.slots)
        model.save(f"{path}/model")
        scored = score_by_terms(self.spark.read.schema(TERMS).parquet(f"{path}/model/terms"), self.test)
        scored.select(self.key, *CAT, *NUM, F.col(fv.TARGET_COLUMN).alias("late_delivery_risk_real"),
                      "late_delivery_risk_pred", "late_delivery_risk_probability").write.parquet(f"{path}/predictions")
        self._record(self.spark.read.parquet(f"{path}/predictions")).write.parquet(f"{path}/record")

    def _fitted(self) -> str:
        return self.store.get(f"model-{self.name}", self._write_model)

    @property
    def model(self) -> LateRiskModel:
        return LateRiskModel.load(f"{self._fitted()}/model")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema(TERMS).parquet(f"{self._fitted()}/model/terms")

    def predictions(self) -> DataFrame:
        """Every scored test row."""
        return self.spark.read.parquet(f"{self._fitted()}/predictions")

    def prediction_head(self, n: int = fv.PREDICTION_SAMPLE_ROWS) -> DataFrame:
        """The first ``n`` scored rows by key: what the dashboard shows."""
        return self.predictions().orderBy(self.key).limit(n)

    def record(self) -> DataFrame:
        """One-row run record: counts, class rates, metrics, settings."""
        return self.spark.read.parquet(f"{self._fitted()}/record")

    def _record(self, scored: DataFrame) -> DataFrame:
        m = mdl.classification_metrics(scored, "late_delivery_risk_real", "late_delivery_risk_pred")
        auc = mdl.roc_auc(scored, "late_delivery_risk_real", "late_delivery_risk_probability").select("roc_auc")
        out = combine_one_row(m, auc, run_counts(self.split))
        return out.select(
            F.lit(fv.MODEL_NAME).alias("model_name"),
            F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz").alias("created_at_utc"),
            F.lit(fv.TARGET_COLUMN).alias("target_column"), "*",
            F.array(*[F.lit(c) for c in CAT]).alias("categorical_features"),
            F.array(*[F.lit(c) for c in NUM]).alias("numerical_features"),
            F.array(*[F.lit(c) for c in fv.LEAKAGE_COLUMNS]).alias("leakage_columns_excluded"),
            F.lit(fv.DECISION_THRESHOLD).alias("decision_threshold"))


def feature_schema(frame: DataFrame, created_at: dt.datetime | None = None) -> DataFrame:
    """Options (top values), defaults, and numeric ranges for scenario input, one row."""
    created_at = created_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    vocab = mdl.category_vocabulary(frame)
    opts = vocab.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"])
        .alias("options"))
    options = opts.agg(F.map_from_entries(F.collect_list(F.struct("feature", "options")))
                       .alias("categorical_options"))
    numbers = median_table(frame, NUM).agg(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("median", "min", "max")))).alias("m")).scalar()

    def of_numbers(part: str, default: float) -> Column:
        return F.create_map(*[x for c in NUM for x in (
            F.lit(c), F.coalesce(F.try_element_at(numbers, F.lit(c))[part], F.lit(default)))])

    cat_defaults = F.map_from_entries(F.transform(
        F.map_entries("categorical_options"),
        lambda e: F.struct(e["key"], F.coalesce(F.element_at(e["value"], 1), F.lit(fv.MISSING_TEXT)))))
    return options.select(
        F.lit(fv.MODEL_NAME).alias("model_type"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at_utc"),
        F.lit(fv.TARGET_COLUMN).alias("target_column"),
        F.array(*[F.lit(c) for c in CAT]).alias("categorical_features"),
        F.array(*[F.lit(c) for c in NUM]).alias("numerical_features"),
        F.array(*[F.lit(c) for c in fv.LEAKAGE_COLUMNS]).alias("leakage_columns_excluded"),
        "categorical_options", cat_defaults.alias("categorical_defaults"),
        of_numbers("median", 0.0).alias("numerical_defaults"),
        of_numbers("min", 0.0).alias("numerical_min"),
        of_numbers("max", 1.0).alias("numerical_max"),
        F.lit(fv.RANDOM_SEED).alias("random_seed"))
