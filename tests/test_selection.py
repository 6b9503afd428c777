import math

import pytest

from skyloom.plans import selection

TEXTS = [
    ("foo == 1.0 && (bar == 4.0 || qux >= 3.5)", "(foo == 1.0) && ((bar == 4.0) || (qux >= 3.5))", [True, False, True]),
    ("~(foo == 1.0 && (bar == 4.0 || qux >= 3.5))", "~((foo == 1.0) && ((bar == 4.0) || (qux >= 3.5)))", [False, True, False]),
    ("isfinite foo", "isfinite foo", [True, True, True]),
    ("", "", [True, True, True]),
    ("foo < bar < 0x2", "(foo < bar) < 2", [True, True, True]),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1.0, 2.0, 3.5), (4.0, 5.8, 6.1), (1.0, 4.0, 3.2)], "foo float, bar float, qux float").coalesce(1)


@pytest.mark.parametrize("text, canonical, mask", TEXTS)
def test_masks(table, text, canonical, mask):
    assert selection.mask(table, text)[0] == canonical
    assert [r.mask for r in selection.with_mask(table, text).collect()] == mask


def test_grammar():
    assert selection.to_string(selection.parse("(FLAG & 0b0000000000000100) == 0")) == "(FLAG & 4) == 0"
    assert selection.to_string(selection.parse("order_id or android and 1")) == "order_id || (android && 1)"
    for bad in ("foo ==", "(foo", "foo bar", "~~foo", "foo & bar", "a $ b", "a -1"):
        with pytest.raises(ValueError):
            selection.parse(bad)


def test_unknown_column(table):
    with pytest.raises(ValueError):
        selection.mask(table, "nope == 1")


def test_nan_and_sentinel(spark):
    df = spark.createDataFrame([(math.nan,), (-1.6375e30,), (None,), (math.inf,), (1.0,)], "x double").coalesce(1)
    got = lambda text: [r.mask for r in selection.with_mask(df, text).collect()]
    assert got("isfinite x") == [False, False, False, False, True]
    assert got("x == x") == [False, True, False, True, True]
    assert got("x != x")[0] is True
    assert got("x > 0") == [False, False, False, True, True]
    narrow = df.selectExpr("cast(x as float) as x")
    assert [r.mask for r in selection.with_mask(narrow, "isfinite x").collect()][1] is False


def test_masked_columns(spark):
    df = spark.createDataFrame([(None, 1.0), (math.nan, 2.0)], "e double, x double").coalesce(1)
    got = lambda text: [r.mask for r in selection.with_mask(df, text, ignore_masked_columns=True).collect()]
    assert got("e == 1 && x < 2") == [True, False]
    assert got("~(e == 1)") == [False, False]
    assert got("isfinite e") == [True, True]


def test_pushed_to_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as double) as x", "id as y").write.parquet(str(tmp_path / "t"))
    df = selection.select(spark.read.parquet(str(tmp_path / "t")), "x >= 3").select("x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,3.0)" in plan and "ReadSchema: struct<x:double>" in plan
