"""Exact numbers, canonical JSON, times."""

from decimal import Decimal

import pytest

from claimloom.functions import canonical, exact, timestamps


@pytest.mark.parametrize("text,want", [("1.0", "1"), ("-0", "0"), ("1e3", "1000"), ("12.3400", "12.34"), ("9007199254740993", "9007199254740993"), ("1E-3", "0.001")])
def test_tokens(text, want):
    assert exact.token(exact.parse(text)) == want


@pytest.mark.parametrize("text", ["01", "+1", ".5", "1.", "NaN", "", "1e9999999999"])
def test_not_numbers(text):
    with pytest.raises((ValueError, OverflowError)):
        exact.parse(text)


def test_limits():
    exact.parse("9" * 128)
    for text in ("9" * 129, "1e1025", "1e-1025"):
        with pytest.raises(OverflowError):
            exact.parse(text)
    assert exact.subtract(exact.add(Decimal("1e100"), Decimal("1e-20")), Decimal("1e100")) == Decimal("1e-20")


def test_division():
    assert exact.token(exact.divide(Decimal(1), Decimal(8))) == "0.125"
    assert exact.token(exact.divide(Decimal("-7.5"), Decimal("2.5"))) == "-3"
    with pytest.raises(ArithmeticError):
        exact.divide(Decimal(1), Decimal(3))
    with pytest.raises(ZeroDivisionError):
        exact.divide(Decimal(1), Decimal(0))


def test_binary():
    assert exact.token(exact.from_binary("3fc00000", 32)) == "1.5"
    assert exact.from_binary("3fb999999999999a", 64) == Decimal(0.1)


def test_canonical():
    assert canonical.dumps(canonical.loads('{"b": 1.0, "a": [true, null, "é\\u0001/"]}')) == '{"a":[true,null,"é\\u0001/"],"b":1}'
    assert canonical.digest({"a": 1, "b": 2}) == canonical.digest({"b": 2, "a": 1})
    assert canonical.digest([1, 2]) != canonical.digest([2, 1])
    assert canonical.digest({}, "x") != canonical.digest({}, "y")
    assert sorted(["\U00010000", ""]) == ["", "\U00010000"]
    for bad in ('{"a":1,"a":2}', "NaN", "[1,]", '"\\ud800"'):
        with pytest.raises(ValueError):
            canonical.loads(bad)


def test_times():
    assert timestamps.text(timestamps.parse("2026-03-31T02:00:00+02:00")) == "2026-03-31T00:00:00.000Z"
    assert timestamps.text(timestamps.parse("0001-01-01T00:00:00.5Z")) == "0001-01-01T00:00:00.500Z"
    for bad in ("2026-01-01T00:00:60Z", "2026-01-01T00:00:00.0001Z", "2026-02-30T00:00:00Z", "2026-01-01 00:00:00Z"):
        with pytest.raises(ValueError):
            timestamps.parse(bad)
    assert timestamps.valid_date("2024-02-29+14:00") and not timestamps.valid_date("2023-02-29") and not timestamps.valid_date("2024-01-01+14:01")
