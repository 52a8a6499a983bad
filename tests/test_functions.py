import pytest
from pyspark.sql import functions as F

from gridweft.functions import scalars as S


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "want"), [("#foo", "foo"), ("foo", "foo"), ("", ""), ("##x", "#x")])
def test_strip_hash(spark, value, want):
    assert one(spark, S.strip_hash, value) == want


@pytest.mark.parametrize(("value", "want"), [(100.0, "100.0"), (1.25e7, "12500000.0"), (1e-5, "0.00001"), (-200.0, "-200.0"), (0.0, "0.0"), (1.5, "1.5"), (1e22, "10000000000000000000000.0"), (float("nan"), "null"), (None, "null")])
def test_float_json(spark, value, want):
    assert one(spark, S.float_json, value, "double") == want


@pytest.mark.parametrize(("value", "want"), [(-200.0, "-2E2"), (150.0, "1.5E2"), (0.001, "1E-3"), (0.0, "0E0")])
def test_float_scientific(spark, value, want):
    assert one(spark, S.float_scientific, value, "double") == want


@pytest.mark.parametrize(("value", "want"), [("1e3", "1000.0"), ("1.50", "1.50"), ("7", "7.0")])
def test_float_text(spark, value, want):
    assert one(spark, S.float_text, value) == want


@pytest.mark.parametrize(("value", "want"), [("", None), ("2026-01-01", None), ("2026-00-01T00:00:00", None), ("2026-13-01T00:00:00", None), ("1970-01-01T08:00:00Z", 28800), ("1970-01-02T01:00:00", 90000), ("1970-02-31T00:00:00", 61 * 86400 - 86400 + 1 * 86400)])
def test_iso_seconds(spark, value, want):
    if value.startswith("1970-02-31"):
        want = (31 + 30) * 86400
    assert one(spark, S.iso_seconds, value) == want


def test_entities_and_enums(spark):
    assert one(spark, S.decode_entities, "a+b &lt;c&gt; &amp;lt;") == "a b <c> &lt;"
    assert one(spark, S.enum_fragment, "http://c#A.b") == "b"
    assert one(spark, lambda c: S.enum_fragment(c, "null"), "plain") is None
    assert one(spark, S.energy_source, "HydroGeneratingUnit") == "HYDRO" and one(spark, S.energy_source, "?") == "OTHER"
    assert one(spark, S.switch_kind, "LoadBreakSwitch") == "LOAD_BREAK_SWITCH"
    assert one(spark, S.date_millis, "2026-01-01T09:00:00Z") == "2026-01-01T09:00:00.000Z"
    assert one(spark, S.number, " 2.5 ") == 2.5 and one(spark, S.number, "1d") is None
