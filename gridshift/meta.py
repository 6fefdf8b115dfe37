"""What is known of an array without looking at its cells."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from math import prod

import numpy as np

#: Fixed value: the attribute that names an array's dimensions.
DIMENSION_KEY = "_ARRAY_DIMENSIONS"

#: Spark types of cells, by NumPy type; unsigned types are held in the next wider one.
SPARK_TYPES = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "b1": "boolean", "f2": "float"}


def plain(x):
    """NumPy scalars and arrays, tuples and the like as what JSON can hold."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, np.ndarray):
        return plain(x.tolist())
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


@dataclass(frozen=True)
class ArrayMeta:
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: object = 0
    order: str = "C"
    attrs: dict = field(default_factory=dict)

    def __post_init__(self):
        for k in ("shape", "chunks"):
            object.__setattr__(self, k, tuple(int(v) for v in getattr(self, k)))
        if np.dtype(self.dtype).kind not in "fiub" or np.dtype(self.dtype).str[1:] not in SPARK_TYPES:
            raise ValueError(f"arrays of dtype {self.dtype} have no cells of a fixed Spark type")
        object.__setattr__(self, "dtype", np.dtype(self.dtype).str)
        if len(self.shape) != len(self.chunks):
            raise ValueError(f"chunks {self.chunks} must have length {len(self.shape)}")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def itemsize(self) -> int:
        return np.dtype(self.dtype).itemsize

    @property
    def spark_type(self) -> str:
        return SPARK_TYPES[self.dtype[1:]]

    @property
    def grid(self) -> tuple[int, ...]:
        """Chunks along each axis."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    @property
    def dims(self) -> tuple[str, ...] | None:
        named = self.attrs.get(DIMENSION_KEY)
        return tuple(named) if named is not None else None

    @property
    def nbytes(self) -> int:
        return self.itemsize * prod(self.shape)

    def with_(self, **changes) -> ArrayMeta:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(plain({"shape": self.shape, "chunks": self.chunks, "dtype": self.dtype, "fill": None if self.fill is None else "NaN" if self.fill != self.fill else self.fill, "order": self.order, "attrs": self.attrs}))

    @classmethod
    def from_json(cls, text: str) -> ArrayMeta:
        d = json.loads(text)
        return cls(**d | {"fill": float("nan") if d["fill"] == "NaN" else d["fill"]})
