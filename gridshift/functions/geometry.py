"""Chunk grids: keys, dimension names and wanted chunks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunk_keys(shape: Sequence[int], chunks: Sequence[int]) -> Iterator[tuple[slice, ...]]:
    """Slices of all chunks in row-major order, the last one of an axis cut off at its end."""
    axes = [[slice(a, min(a + c, n)) for a in range(0, n, c)] for n, c in zip(shape, chunks, strict=True)]
    yield from product(*axes)


def keys_frame(spark: SparkSession, shape: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """The same as rows ``k0.., start0.., stop0..``: one generator an axis, made on the executors."""
    counts = [-(-n // c) for n, c in zip(shape, chunks, strict=True)]
    total = 1
    for n in counts:
        total *= n
    cols, below = [], 1
    for axis in reversed(range(len(counts))):
        cols.insert(0, F.expr(f"id div {below}L % {counts[axis]}L").alias(f"k{axis}"))
        below *= counts[axis]
    df = spark.range(total).select(*cols)
    for axis, (n, c) in enumerate(zip(shape, chunks, strict=True)):
        k = F.col(f"k{axis}")
        df = df.withColumn(f"start{axis}", k * c).withColumn(f"stop{axis}", F.least((k + 1) * c, F.lit(n).cast("long")))
    return df


def shape_dict_to_tuple(dims: Sequence[str], sizes: Mapping[str, int]) -> tuple[int, ...]:
    """Sizes in the order of ``dims``; more keys do no harm, a missing one is a KeyError."""
    return tuple(sizes[d] for d in dims)


def dim_chunk(length: int, own: int | None, dim: str, wanted: Mapping[str, int]) -> int:
    """One dimension's chunk: as wanted, the full length if that is negative or too long, else its own chunk or the full length."""
    if dim in wanted:
        n = wanted[dim]
        return length if n < 0 or n > length else n
    return length if own is None else own


def dim_chunks_to_targets(variables: Mapping[str, tuple[Sequence[str], Sequence[int], Sequence[int] | None]], wanted: Mapping[str, int]) -> dict[str, tuple[int, ...]]:
    """Each variable's target chunks from chunks by dimension. ``variables``: name to (dims, shape, own chunks or None)."""
    return {
        name: tuple(dim_chunk(n, None if chunks is None else chunks[k], d, wanted) for k, (d, n) in enumerate(zip(dims, shape, strict=True)))
        for name, (dims, shape, chunks) in variables.items()
    }
