"""Changing an array's chunk grid: a copy, a local split, or one exchange keyed by the new chunk."""

from __future__ import annotations

from itertools import product
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..meta import ArrayMeta
from ..plans.planner import multistage_rechunking_plan
from ..sources.frames import ArrayFrame, from_cells

#: Reduce partitions of one regrid at most; more write blocks than that share partitions.
MAX_PARTITIONS = 100_000
#: Bytes of a reduce partition that is not a single write block, about. Small blocks share one; they are joined one after the other.
PARTITION_BYTES = 64 << 20


def refines(meta: ArrayMeta, chunks: tuple[int, ...]) -> bool:
    """Whether each new chunk lies within one old chunk, so that nothing needs to be exchanged."""
    return all(c % t == 0 or n <= c for n, c, t in zip(meta.shape, meta.chunks, chunks, strict=True))


def _schema(meta: ArrayMeta, *more: T.StructField) -> T.StructType:
    cell = {"float": T.FloatType(), "double": T.DoubleType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType()}[meta.spark_type]
    return T.StructType([*(T.StructField(f"k{a}", T.LongType()) for a in range(meta.ndim)), *more, T.StructField("payload", T.ArrayType(cell))])


def _box(meta: ArrayMeta, key) -> list[tuple[int, int]]:
    return [(k * c, min((k + 1) * c, n)) for k, c, n in zip(key, meta.chunks, meta.shape, strict=True)]


def _pieces(meta: ArrayMeta, target: ArrayMeta, key):
    """Of a chunk: each new chunk that it meets, where the piece begins in it, and the piece's slices here."""
    axes = []
    for (lo, hi), t in zip(_box(meta, key), target.chunks, strict=True):
        axes.append([(k, max(lo, k * t) - k * t, slice(max(lo, k * t) - lo, min(hi, (k + 1) * t) - lo)) for k in range(lo // t, (hi - 1) // t + 1)])
    for found in product(*axes):
        yield tuple(f[0] for f in found), [f[1] for f in found], tuple(f[2] for f in found)


def _split(meta: ArrayMeta, target: ArrayMeta, whole: bool):
    """A kernel for ``mapInArrow``: chunks to pieces, each a contiguous copy; payloads stay Arrow buffers."""
    names = [f"k{a}" for a in range(meta.ndim)] + ([] if whole else ["at", "size"]) + ["payload"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys = np.stack([b.column(a).to_numpy() for a in range(meta.ndim)], axis=1) if b.num_rows else ()
            for key, cells in zip(keys, b.column(meta.ndim), strict=True):
                box = _box(meta, key.tolist())
                block = cells.values.to_numpy(zero_copy_only=False).reshape([hi - lo for lo, hi in box], order=meta.order)
                rows, buffers = [], []
                for to, at, here in _pieces(meta, target, key.tolist()):
                    piece = block[here]
                    rows.append((*to, at, list(piece.shape)))
                    buffers.append(piece.ravel(order=target.order))
                cols = list(zip(*rows, strict=True))
                offsets = np.cumsum([0, *map(len, buffers)]).astype("i4")
                arrays = [pa.array(c, pa.int64()) for c in cols[: meta.ndim]]
                if not whole:
                    arrays += [pa.array(cols[meta.ndim], pa.list_(pa.int64())), pa.array(cols[meta.ndim + 1], pa.list_(pa.int64()))]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(buffers), cells.values.type)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _join(meta: ArrayMeta, target: ArrayMeta):
    """A kernel for ``applyInArrow``: all pieces of one new chunk to the chunk; missing cells hold the fill value."""

    def run(table):
        import pyarrow as pa

        key = [table.column(f"k{a}")[0].as_py() for a in range(target.ndim)]
        box = _box(target, key)
        out = None
        for at, size, cells in zip(table.column("at").to_pylist(), table.column("size").to_pylist(), table.column("payload"), strict=True):
            piece = cells.values.to_numpy(zero_copy_only=False)
            if out is None:
                out = np.full([hi - lo for lo, hi in box], target.fill, piece.dtype)
            out[tuple(slice(a, a + n) for a, n in zip(at, size, strict=True))] = piece.reshape(size, order=target.order)
        flat = pa.array(out.ravel(order=target.order))
        return pa.table([*(pa.array([k], pa.int64()) for k in key), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=[*(f"k{a}" for a in range(target.ndim)), "payload"])

    return run


def copy(array: ArrayFrame, target: ArrayMeta) -> ArrayFrame:
    """Same grid: rows go through as they are; a new payload order is a local change."""
    if array.meta.order == target.order or target.ndim < 2:
        return ArrayFrame(target, array.df.select(*array.keys, "payload"))
    return ArrayFrame(target, array.df.select(*array.keys, "payload").mapInArrow(_split(array.meta, target, True), _schema(target)))


def by_fragments(array: ArrayFrame, target: ArrayMeta, block: tuple[int, ...] | None = None) -> ArrayFrame:
    """Chunks are cut into pieces, the pieces dealt to their write block's partition, and joined there.

    One exchange of as many bytes as the array has and one row a piece. ``block``: the planned write
    chunks (whole multiples of the target's), which stay together. A partition is one block or, where blocks
    are small, several (about PARTITION_BYTES); its chunks are joined one at a time either way.
    """
    meta = array.meta
    rows = array.df.select(*array.keys, "payload")
    if refines(meta, target.chunks):
        return ArrayFrame(target, rows.mapInArrow(_split(meta, target, True), _schema(target)))
    per = [max(1, b // t) for b, t in zip(block or target.chunks, target.chunks, strict=True)]
    blocks = [-(-g // p) for g, p in zip(target.grid, per, strict=True)]
    enough = max(int(array.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-target.nbytes // PARTITION_BYTES))
    parts = min(prod(blocks), enough, MAX_PARTITIONS)
    longs = T.ArrayType(T.LongType())
    pieces = rows.mapInArrow(_split(meta, target, False), _schema(target, T.StructField("at", longs), T.StructField("size", longs)))
    wid = F.lit(0).cast("long")
    for a, (p, n) in enumerate(zip(per, blocks, strict=True)):
        wid = wid * n + F.expr(f"k{a} div {p}L")
    pieces = pieces.withColumn("wid", (wid % parts).cast("int")).repartitionById(parts, F.col("wid"))
    return ArrayFrame(target, pieces.groupBy("wid", *array.keys).applyInArrow(_join(meta, target), _schema(target)))


def by_cells(array: ArrayFrame, target: ArrayMeta) -> ArrayFrame:
    """Cell by cell in generated code only: an exchange of one row a cell. What SQL says a regrid is."""
    return ArrayFrame(target, from_cells(array.cells(), target).df)


def regrid(array: ArrayFrame, chunks: tuple[int, ...], block: tuple[int, ...] | None = None, **changes) -> ArrayFrame:
    """``array`` on a new grid, by the cheapest way that its grids allow."""
    target = array.meta.with_(chunks=tuple(chunks), **changes)
    return copy(array, target) if target.chunks == array.meta.chunks else by_fragments(array, target, block)


def regrid_in_stages(array: ArrayFrame, chunks: tuple[int, ...], min_mem: int, max_mem: int) -> ArrayFrame:
    """The multi-stage plan carried out: each stage one exchange (to the stage's write chunks, the last to ``chunks``)."""
    plan = multistage_rechunking_plan(array.meta.shape, array.meta.chunks, chunks, array.meta.itemsize, min_mem, max_mem)
    for k, (_, _, write) in enumerate(plan):
        array = regrid(array, tuple(chunks) if k == len(plan) - 1 else write, write)
    return array


def drop_empty(array: ArrayFrame) -> ArrayFrame:
    """Without the chunks that hold the fill value only."""
    fill = F.lit(array.meta.fill).cast(array.meta.spark_type)
    return ArrayFrame(array.meta, array.df.where(~F.forall("payload", lambda x: x.eqNullSafe(fill))))


def fragments(array: ArrayFrame, target: ArrayMeta) -> DataFrame:
    """How each chunk is cut: its key (``s0..``), the new chunk's key (``t0..``) and the number of cells."""
    meta = array.meta
    old, new = [f"s{a}" for a in range(meta.ndim)], [f"t{a}" for a in range(meta.ndim)]
    d = array.cells()
    for a in range(meta.ndim):
        d = d.withColumn(old[a], F.expr(f"i{a} div {meta.chunks[a]}L")).withColumn(new[a], F.expr(f"i{a} div {target.chunks[a]}L"))
    return d.groupBy(*old, *new).agg(F.count("*").alias("cells"))
