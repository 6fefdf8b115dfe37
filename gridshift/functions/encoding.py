"""CF packing of values, and attributes that a store can hold."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import plain

#: The encoding keys that change how values are stored.
PACKING = ("scale_factor", "add_offset", "_FillValue", "dtype")


def encode_attributes(attrs: Mapping) -> dict:
    """Attributes with NumPy values turned into plain ones."""
    return {str(k): plain(v) for k, v in attrs.items()}


def _bare(value: Column, encoding: Mapping) -> Column:
    x = value.cast("double")
    if encoding.get("add_offset") is not None:
        x = x - F.lit(float(encoding["add_offset"]))
    if encoding.get("scale_factor") is not None:
        x = x / F.lit(float(encoding["scale_factor"]))
    return x


def pack(value: Column, encoding: Mapping, spark_type: str) -> Column:
    """(value - add_offset) / scale_factor, rounded half to even for whole-number types; NaN becomes _FillValue."""
    x = _bare(value, encoding)
    if np.dtype(encoding.get("dtype", "f8")).kind in "iu":
        x = F.rint(x)
    if encoding.get("_FillValue") is not None:
        x = F.when(F.isnan(value.cast("double")) | value.isNull(), F.lit(float(encoding["_FillValue"]))).otherwise(x)
    return x.cast(spark_type)


def unpack(value: Column, encoding: Mapping) -> Column:
    """value * scale_factor + add_offset; _FillValue becomes NaN."""
    x = value.cast("double")
    if encoding.get("scale_factor") is not None:
        x = x * F.lit(float(encoding["scale_factor"]))
    if encoding.get("add_offset") is not None:
        x = x + F.lit(float(encoding["add_offset"]))
    if encoding.get("_FillValue") is not None:
        x = F.when(value.cast("double") == F.lit(float(encoding["_FillValue"])), F.lit(float("nan"))).otherwise(x)
    return x


def pack_all(payload: str, encoding: Mapping, spark_type: str) -> Column:
    """:func:`pack` for each cell of an array column."""
    return F.transform(payload, lambda v: pack(v, encoding, spark_type))


def unpack_all(payload: str, encoding: Mapping) -> Column:
    return F.transform(payload, lambda v: unpack(v, encoding))
