"""Property checks of the column functions against plain-Python statements
of the same rules."""

import hashlib
import string

import pytest
from hypothesis import given, settings, strategies as st

from shipwatch.functions import clean_text, hash_identifier
from shipwatch.functions.names import normalize_column_name, normalize_names

WS = " \t\n\x0b\f\r"


@given(st.text(alphabet=string.ascii_letters + string.digits + " -/()_.#$%\t", max_size=30))
def test_snake_case_rule(name):
    got = normalize_column_name(name)
    assert got == got.lower() and "__" not in got and not got.startswith("_") and not got.endswith("_")
    # letters and digits survive in their order, and nothing else but the joints
    assert got.replace("_", "") == "".join(c for c in name if c.isalnum()).lower()
    assert normalize_column_name(got) == got
    assert normalize_column_name(f"  {name}\t") == got == normalize_column_name(name.replace("-", "/").replace(" ", "__"))


@pytest.mark.parametrize(("raw", "want"), [
    ("order date (DateOrders)", "order_date_dateorders"), ("Days for shipping (real)", "days_for_shipping_real"),
    ("Late_delivery_risk", "late_delivery_risk"), ("  A--B//c  ", "a_b_c"), ("pr%ice $", "price"), ("a.b", "ab"), ("(x)", "x"),
    ("", ""), ("_-/", ""), ("Ünit 5", "nit_5")])
def test_snake_case_examples(raw, want):
    assert normalize_column_name(raw) == want


def test_colliding_names_are_rejected():
    with pytest.raises(ValueError, match="both normalise"):
        normalize_names(["Order Id", "x", "order-id"])
    assert normalize_names(["a b", "a-b"], reject_collisions=False) == ["a_b", "a_b"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=string.ascii_letters + WS, max_size=6)),
                min_size=1, max_size=40))
def test_clean_text_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r.c for r in df.select(clean_text("t").alias("c")).collect()]
    want = ["UNKNOWN" if v is None or v.strip(WS) in ("", "nan") else v.strip(WS) for v in values]
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-10**12, max_value=10**12)), min_size=1,
                max_size=40))
def test_hash_identifier_rule(spark, ids):
    df = spark.createDataFrame([(v,) for v in ids], "c long")
    got = [r.h for r in df.select(hash_identifier("c").alias("h")).collect()]
    want = ["cust_" + hashlib.sha256(("nan" if v is None else str(v)).encode()).hexdigest()[:16]
            for v in ids]
    assert got == want
