"""Exact decimal numbers: up to 128 significant digits, adjusted exponent within 1024."""

from __future__ import annotations

import decimal
import re
import struct
from decimal import Decimal

DIGITS, EXPONENT, LEXEME = 128, 1024, 8192
_CONTEXT = decimal.Context(prec=4 * DIGITS, Emin=-10**6, Emax=10**6, traps=[decimal.InvalidOperation, decimal.DivisionByZero, decimal.Overflow])
_LEXICAL = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", re.A)


def _held(value: Decimal) -> Decimal:
    """value without trailing zeros, if it is within the limits."""
    if not value:
        return Decimal(0)
    sign, digits, exponent = value.as_tuple()
    kept = len(digits)
    while digits[kept - 1] == 0:
        kept -= 1
    exponent += len(digits) - kept
    if kept > DIGITS or abs(exponent + kept - 1) > EXPONENT:
        raise OverflowError("number beyond 128 digits or exponent 1024")
    return Decimal((sign, digits[:kept], exponent))


def parse(text: str) -> Decimal:
    """A JSON number, exactly."""
    if len(text) > LEXEME or not _LEXICAL.fullmatch(text):
        raise ValueError("not a number")
    exponent = re.search(r"[eE]([+-]?\d+)", text)
    if exponent and len(exponent[1]) > 7:
        raise OverflowError("number beyond exponent 1024")
    return _held(_CONTEXT.create_decimal(text))


def add(a: Decimal, b: Decimal) -> Decimal:
    return _held(_wide(a, b).add(a, b))


def subtract(a: Decimal, b: Decimal) -> Decimal:
    return _held(_wide(a, b).subtract(a, b))


def multiply(a: Decimal, b: Decimal) -> Decimal:
    return _held(_CONTEXT.multiply(a, b))


def _wide(a: Decimal, b: Decimal) -> decimal.Context:
    """A context in which a sum of numbers far apart isn't rounded."""
    return decimal.Context(prec=4 * EXPONENT + 4 * DIGITS, Emin=-10**6, Emax=10**6)


def divide(a: Decimal, b: Decimal) -> Decimal:
    """The quotient, if its decimal expansion ends."""
    if not b:
        raise ZeroDivisionError("division by zero")
    if not a:
        return Decimal(0)
    n, m = a.as_integer_ratio(), b.as_integer_ratio()
    top, bottom = n[0] * m[1], n[1] * m[0]
    from math import gcd

    g = gcd(top, bottom)
    top, bottom = (top // g, bottom // g) if bottom > 0 else (-top // g, -bottom // g)
    twos = (bottom & -bottom).bit_length() - 1
    rest, fives = bottom >> twos, 0
    while rest % 5 == 0:
        rest //= 5
        fives += 1
    if rest != 1:
        raise ArithmeticError("quotient does not end")
    k = max(twos, fives)
    digits = top * 2 ** (k - twos) * 5 ** (k - fives)
    whole = Decimal((int(digits < 0), tuple(map(int, str(abs(digits)))), -k)) if len(str(abs(digits))) <= 4000 else None
    if whole is None:
        raise OverflowError("number beyond 128 digits")
    return _held(whole)


def is_integer(a: Decimal) -> bool:
    return a == a.to_integral_value()


def token(a: Decimal) -> str:
    """The plain spelling: no exponent, no trailing zeros, no negative zero."""
    return format(_held(a), "f")


def from_binary(bits: str, width: int) -> Decimal:
    """The exact value of a finite binary32 or binary64, given in hex."""
    value = struct.unpack({32: ">f", 64: ">d"}[width], bytes.fromhex(bits))[0]
    if value != value or value in (float("inf"), float("-inf")):
        raise ValueError("not finite")
    return _held(Decimal(value))
