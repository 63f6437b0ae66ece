"""The fit is checked by its objective, the encoder and scaler by their tables."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shipwatch import fixed_values as fv
from shipwatch.operators import encoding, learn
from shipwatch.plans import catalog
from shipwatch.sources.committed import Store
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def train(spark):
    return catalog.frame(spark, SF_SMALL).where("order_item_id % 4 <> 0").checkpoint()


@pytest.fixture(scope="module")
def model(train):
    return learn.fit_late_risk_model(train)


def test_solution_has_no_gradient(train, model):
    """Mean weighted log loss plus the penalty |b|^2 / (2 n) is stationary at the coefficients."""
    rows = learn.score(model, train).select(vector_to_array("features").alias("x"), fv.TARGET_COLUMN).collect()
    x = np.array([r.x for r in rows])
    y = np.array([r[fv.TARGET_COLUMN] for r in rows], float)
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    fitted = model.stages[-1]
    b, c = fitted.coefficients.toArray(), fitted.intercept

    def parts(b, c):
        z = x @ b + c
        p = 1 / (1 + np.exp(-z))
        loss = (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum() + (b @ b) / (2 * n)
        return loss, x.T @ (w * (p - y)) / w.sum() + b / n, (w * (p - y)).sum() / w.sum()

    loss, slope, rise = parts(b, c)
    start, start_slope, _ = parts(np.zeros_like(b), 0.0)
    assert loss < start
    assert np.linalg.norm(slope) < 0.02 * np.linalg.norm(start_slope) and abs(rise) < 1e-3


def test_slots_follow_the_table(train, model):
    table = {(r.feature, r.value): r.slot for r in learn.encoder_slots(train).collect()}
    names = learn.feature_names(model)
    assert len(table) == len(names) - len(fv.NUMERICAL_FEATURES)
    at = 0
    for c in fv.CATEGORICAL_FEATURES:
        mine = sorted((s, v) for (f, v), s in table.items() if f == c)
        for slot, value in mine:
            want = learn.INFREQUENT if value is None else value
            assert names[at + slot] == f"categorical__{c}_{want}"
        at += len(mine)


def test_probability_is_monotone_in_the_score(train, model):
    scored = learn.score(model, train)
    wrong = scored.where((F.col("late_delivery_risk_probability") > 0.5) != (F.col("late_delivery_risk_pred") == 1))
    assert wrong.count() == 0


def test_scores_by_terms_equal_the_fitted_stages(train, model, spark):
    test = catalog.frame(spark, SF_SMALL).where("order_item_id % 4 = 0").checkpoint()
    odd = test.withColumn("market", F.lit("a market never seen")).withColumn("order_city", F.lit(None).cast("string")).where("order_item_id % 96 = 0") \
        .na.fill("UNKNOWN", ["order_city"]).withColumn("order_item_id", F.col("order_item_id") + 10 ** 9)
    rows = test.unionByName(odd)
    name = "late_delivery_risk_probability"
    staged = {r.order_item_id: r for r in learn.score(model, rows).select("order_item_id", name, "late_delivery_risk_pred").collect()}
    summed = learn.score_by_terms(model.terms, rows).collect()
    assert len(summed) == len(staged) > 1000
    assert all(abs(r[name] - staged[r.order_item_id][name]) < 1e-9 and r.late_delivery_risk_pred == staged[r.order_item_id].late_delivery_risk_pred
               for r in summed)


def test_model_is_saved_and_loaded_with_its_terms(train, model, tmp_path):
    again = learn.LateRiskModel.load(model.save(str(tmp_path / "model")))
    assert sorted(map(str, again.terms.collect())) == sorted(map(str, model.terms.collect()))
    a, b = (learn.score(m, train.limit(20)).select("order_item_id", "late_delivery_risk_probability").collect() for m in (model, again))
    assert sorted(a) == sorted(b)


def test_encoded_rows_have_one_slot_a_feature(train, model):
    rows = encoding.encoded_rows(train, model.slots, "order_item_id").collect()
    names = learn.feature_names(model)
    given = {r.order_item_id: r for r in train.collect()}
    known = set(names)
    for r in rows[:300]:
        want = []
        for c in fv.CATEGORICAL_FEATURES:
            name = f"categorical__{c}_{given[r.order_item_id][c]}"
            want.append(name if name in known else f"categorical__{c}_{learn.INFREQUENT}")
        assert [names[i] for i in r.slots] == want
    assert len(rows) == len(given)


def test_runs_over_the_same_rows_share_one_fit(spark, tmp_path, monkeypatch):
    fits = []
    fit = learn.fit_late_risk_model
    monkeypatch.setattr(learn, "fit_late_risk_model", lambda *a, **k: fits.append(1) or fit(*a, max_iter=5, **k))
    source = catalog.model_source(spark, SF_SMALL).checkpoint()
    store = Store(spark, str(tmp_path / "store"))
    one = learn.TrainingRun(source, store)
    with monkeypatch.context() as broken:                 # a run that breaks commits nothing
        broken.setattr(learn, "run_counts", lambda split: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            one.predictions()
    assert store.find(f"model-{one.name}") is None
    first = one.predictions().collect()
    two = learn.TrainingRun(source.repartition(3).select(*reversed(source.columns)), store)
    assert two.name == one.name and sorted(two.predictions().collect()) == sorted(first) and len(fits) == 2
    assert two.record().collect() == one.record().collect()
    other = learn.TrainingRun(source.where("order_item_id <> 1000003 or true").withColumn(
        "sales", F.when(F.col("order_item_id") == source.agg(F.min("order_item_id")).first()[0], 0.0).otherwise(F.col("sales"))), store)
    assert other.name != one.name


def test_no_vocabulary_comes_to_the_driver(spark, train):
    """Rows meet the encoder by joins; what is collected for the fit is a row a feature."""
    slots = learn.encoder_slots(train).checkpoint()
    plan = encoding.with_slots(train, slots)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") >= len(fv.CATEGORICAL_FEATURES) and "In(" not in plan
    assert not hasattr(learn, "frequent_vocabulary")


def test_split_is_that_of_the_frame_and_stored_rows_are_not_made_again(spark, tmp_path):
    from shipwatch.operators import model as mdl, sample
    from shipwatch.sources import fixtures as fx
    orders, store = catalog.model_source(spark, SF_SMALL), Store(spark, str(tmp_path / "store"))
    run = learn.TrainingRun(orders, store, inputs=fx.line_inputs(spark, SF_SMALL))
    want = sample.stratified_split(mdl.model_frame(orders), "order_item_id", fv.TARGET_COLUMN)
    assert run.split.columns == want.columns and run.split.exceptAll(want).isEmpty() and want.exceptAll(run.split).isEmpty()
    # the same tables: neither the name nor the split runs the plan of the rows
    failing = orders.withColumn("quantity", F.raise_error(F.lit("rows made again")).cast("string"))
    again = learn.TrainingRun(failing, store, inputs=[t.repartition(2) for t in fx.line_inputs(spark, SF_SMALL)])
    assert again.name == run.name and again.split.count() == want.count()
    other = [t.where("p_partkey <> 1") if "p_partkey" in t.columns else t for t in fx.line_inputs(spark, SF_SMALL)]
    assert learn.TrainingRun(orders, store, inputs=other).name != run.name


def test_line_inputs_name_every_column_that_order_lines_read(spark):
    import re
    from shipwatch.sources import fixtures as fx
    plan = fx.order_lines(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    read = {c for x in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) for c in re.findall(r"([a-z]_[a-z]+)#", x)}
    assert {"l_orderkey", "c_mktsegment"} <= read <= {c for columns in fx.LINE_INPUTS.values() for c in columns}


def test_stored_vectors_are_those_of_the_stages_and_name_no_slot(train, model, spark, tmp_path):
    """A slot named in a column's metadata goes with every task: one a product outgrows an executor."""
    slots, figures = model.slots.checkpoint(), learn.training_figures(train)
    widths = {r.feature: r.width for r in slots.groupBy("feature").agg((F.max("slot") + 1).alias("width")).collect()}
    rows = learn.feature_rows(train, slots, widths, learn.population_scaler(train, figures), figures, str(tmp_path / "rows"))
    assert all(f.metadata == {} for f in rows.schema)
    as_array = vector_to_array("features").alias("x")
    want = learn.balanced_weights(learn.score(model, train)).select(as_array, F.col(fv.TARGET_COLUMN).cast("double"), "class_weight")
    assert sorted(map(str, rows.select(as_array, fv.TARGET_COLUMN, "class_weight").collect())) == sorted(map(str, want.collect()))


def test_a_fit_leaves_no_vectors_behind(spark, train, model):
    import os
    from shipwatch.session import shared_path
    folder = shared_path(spark, "").removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("features-")]


def test_features_of_few_values_are_sent_whatever_the_size_of_all(spark, train, model, monkeypatch):
    """Rows shuffled by a text of four values meet in four tasks."""
    slots, key = model.slots.checkpoint(), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        plans = [encoding.with_slots(train, slots), learn.score_by_terms(model.terms, train)]
        assert all(df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == len(fv.CATEGORICAL_FEATURES) for df in plans)
        monkeypatch.setattr(encoding, "FEW_VALUES", 0)
        assert "BroadcastHashJoin" not in encoding.with_slots(train, slots)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
