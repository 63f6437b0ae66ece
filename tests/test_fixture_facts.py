"""Facts about the sf0.01 test data recorded in FIXTURES.md, recomputed here."""

import pytest
from pyspark.sql import functions as F

from shipwatch.plans import catalog
from tests.conftest import SF_MID


def _counts(df, col):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_order_lines_shape(spark):
    lines = catalog.lines(spark, SF_MID)
    assert lines.count() == 60000
    assert lines.select("order_item_id").distinct().count() == 60000
    by_mode = {r.shipping_mode: r.rate for r in lines.groupBy("shipping_mode")
               .agg(F.avg("late_delivery_risk").alias("rate")).collect()}
    assert by_mode["Same Day"] == pytest.approx(0.8586, abs=5e-5)
    assert by_mode["First Class"] == pytest.approx(0.7152, abs=5e-5)
    assert by_mode["Second Class"] == pytest.approx(0.5672, abs=5e-5)
    assert by_mode["Standard Class"] == pytest.approx(0.2855, abs=5e-5)


def test_conformance_classes(spark):
    conf = catalog.QUERIES["milestone_conformance"](spark, SF_MID)
    assert _counts(conf, "conformance") == {"EARLY": 397, "IN_WINDOW": 303, "LATE": 35,
                                            "MISSING": 359265, "UNPLANNED": 15}


def test_iot_states(spark):
    got = _counts(catalog.classified(spark, SF_MID), "iot_status")
    assert got == {"NORMAL": 2192, "TEMP_ALERT": 1377, "HUMIDITY_ALERT": 2609,
                   "VIBRATION_ALERT": 686, "MULTI_ALERT": 3136}


def test_stock_states(spark):
    got = _counts(catalog.inventory(spark, SF_MID), "inventory_status")
    assert got == {"LOW_STOCK": 1057, "WATCH": 270, "NORMAL": 624, "NO_STOCK_ROW": 49}


def test_roc_auc(spark):
    auc = catalog.QUERIES["roc_auc"](spark, SF_MID).first().roc_auc
    assert auc == pytest.approx(0.602746, abs=5e-7)


def test_plan_sizes(spark):
    assert catalog.QUERIES["milestone_plan"](spark, SF_MID).count() == 6 * 60000
    split = catalog.QUERIES["stratified_split"](spark, SF_MID)
    assert split.filter("split = 'test'").count() + split.filter("split = 'train'").count() == 60000
