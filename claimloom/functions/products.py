"""Exact products of whole numbers of any length, as columns.

A number is an array of limbs of nine digits, the least first, without leading
zero limbs.  Everything is a built-in function, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a limb.  A limb times a factor of at most 10^9, and a carry, fit into a long.
DIGITS = 9
BASE = 10**DIGITS


def one() -> Column:
    return F.array(F.lit(1).cast("long"))


def times(number: Column, factor: Column) -> Column:
    """number times a whole factor from 0 to 10^9; another factor is an error."""
    factor = F.when((factor >= 0) & (factor <= BASE), factor.cast("long")).otherwise(F.raise_error(F.lit("a factor beyond 10^9")).cast("long"))

    def step(acc: Column, limb: Column) -> Column:
        whole = limb * factor + acc["carry"]
        low = F.pmod(whole, F.lit(BASE))
        return F.struct(F.concat(acc["limbs"], F.array(low)).alias("limbs"), F.call_function("div", whole, F.lit(BASE).cast("long")).alias("carry"))

    zero = F.struct(F.array().cast("array<bigint>").alias("limbs"), F.lit(0).cast("long").alias("carry"))
    out = F.aggregate(number, zero, step, lambda acc: F.when(acc["carry"] > 0, F.concat(acc["limbs"], F.array(acc["carry"]))).otherwise(acc["limbs"]))
    return F.when(factor == 0, F.array(F.lit(0).cast("long"))).otherwise(out)


def text(number: Column) -> Column:
    """Its decimal digits."""
    rest = F.transform(F.reverse(F.slice(number, F.lit(1), F.size(number) - 1)), lambda limb: F.lpad(limb.cast("string"), DIGITS, "0"))
    return F.concat(F.element_at(number, -1).cast("string"), F.array_join(rest, ""))


def order(number: Column) -> Column:
    """A column that sorts as the numbers do."""
    return F.struct(F.size(number).alias("size"), F.reverse(number).alias("limbs"))
