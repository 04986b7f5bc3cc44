"""Columns that an operator carries along without reading them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

REST = "_rest"


def carried(docs: DataFrame, core: Sequence[str], without: Sequence[str] = ()) -> DataFrame:
    """The ``core`` columns, and all others but ``without`` in one struct, so that no name clashes with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in core and c not in without]
    return docs.select(*core, (F.struct(*rest) if rest else F.lit(None).cast("struct<none:int>")).alias(REST))


def restored(docs: DataFrame, core: Sequence[str], without: Sequence[str] = (), **changed: Column) -> list[Column]:
    """The columns of ``docs`` again, in their order, from a frame that ``carried`` them."""
    return [
        changed[c].alias(c) if c in changed else F.col(c) if c in core else F.col(REST).getField(c).alias(c) for c in docs.columns if c not in without
    ]
