"""Bit-flag predicates over an integer flag column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def any_bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def set_bits(flags: Column, mask: int) -> Column:
    return flags.bitwiseOR(F.lit(mask))


def toggle_bits(flags: Column, mask: int) -> Column:
    return flags.bitwiseXOR(F.lit(mask))


def clear_bits(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.bitwise_not(F.lit(mask)))
