"""Arrays, groups of arrays and labelled datasets as DataFrames of chunk rows.

A chunk row has ``k0 .. k{n-1}`` (the chunk's place in the grid) and ``payload`` (its cells, in C or
F order). Chunks that have no row hold the fill value only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import keys_frame
from ..meta import ArrayMeta


def _div(a, b) -> Column:
    """Whole-number quotient of non-negative longs, inside generated code."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def width(meta: ArrayMeta, axis: int, key: Column) -> Column:
    """Cells of a chunk along an axis; the last chunk is cut off."""
    n, c = meta.shape[axis], meta.chunks[axis]
    return F.lit(c).cast("long") if n % c == 0 else F.least(F.lit(c).cast("long"), F.lit(n).cast("long") - key * c)


def place(meta: ArrayMeta, index: list[Column], keys: list[Column]) -> Column:
    """A cell's position in its chunk's payload."""
    axes = range(meta.ndim) if meta.order == "C" else reversed(range(meta.ndim))
    at = F.lit(0).cast("long")
    for a in axes:
        at = at * width(meta, a, keys[a]) + (index[a] - keys[a] * meta.chunks[a])
    return at


@dataclass
class ArrayFrame:
    meta: ArrayMeta
    df: DataFrame
    path: str | None = None
    #: Not yet in a store: chunks are computed when they are read, so reads are not consolidated.
    lazy: bool = False
    name: str | None = None
    #: What the files at ``path`` are: "parquet" (chunk rows) or "zarr".
    format: str = "parquet"

    @property
    def keys(self) -> list[str]:
        return [f"k{a}" for a in range(self.meta.ndim)]

    @property
    def attrs(self) -> dict:
        return self.meta.attrs

    def __repr__(self) -> str:
        m = self.meta
        return f"<ArrayFrame {self.path or 'lazy'} shape={m.shape} chunks={m.chunks} dtype={m.dtype}>"

    def _repr_html_(self) -> str:
        import html

        m = self.meta
        rows = "".join(f"<tr><th>{k}</th><td>{html.escape(str(v))}</td></tr>" for k, v in (("store", self.path or "lazy"), ("shape", m.shape), ("chunks", m.chunks), ("dtype", m.dtype), ("bytes", m.nbytes)))
        return f"<table>{rows}</table>"

    def complete(self) -> DataFrame:
        """Chunk rows with those that are not stored put in as fill value."""
        m, spark = self.meta, self.df.sparkSession
        all_keys = keys_frame(spark, m.shape, m.chunks).select(*self.keys)
        cells = F.lit(1).cast("long")
        for a, k in enumerate(self.keys):
            cells = cells * width(m, a, F.col(k))
        blank = F.array_repeat(F.lit(m.fill).cast(m.spark_type), cells.cast("int"))
        return all_keys.join(self.df, self.keys, "left").withColumn("payload", F.coalesce("payload", blank))

    def cells(self) -> DataFrame:
        """Rows ``i0 .. i{n-1}, v``, one a stored cell, by code that Spark generates."""
        m = self.meta
        d = self.df.select(*self.keys, F.posexplode("payload").alias("_p", "v"))
        rest, index = F.col("_p").cast("long"), {}
        axes = list(reversed(range(m.ndim))) if m.order == "C" else list(range(m.ndim))
        for a in axes:
            w = width(m, a, F.col(f"k{a}"))
            index[a] = F.col(f"k{a}") * m.chunks[a] + rest % w
            rest = _div(rest, w)
        return d.select(*(index[a].alias(f"i{a}") for a in range(m.ndim)), "v")

    def read(self, *slices: slice) -> DataFrame:
        """Cells within a box. Chunks outside of it are pruned by ranges on the key columns, which reach the scan."""
        m, d, want = self.meta, self.df, []
        for a, s in enumerate(slices):
            lo, hi, step = s.indices(m.shape[a])
            if step != 1:
                raise ValueError("slices have step 1")
            k = F.col(f"k{a}")
            d = d.where((k >= lo // m.chunks[a]) & (k <= max(lo, hi - 1) // m.chunks[a]))
            want.append((F.col(f"i{a}") >= lo) & (F.col(f"i{a}") < hi))
        out = ArrayFrame(m, d).cells()
        for w in want:
            out = out.where(w)
        return out

    def to_numpy(self) -> np.ndarray:
        """All cells on the driver; for arrays that are known to be small."""
        m = self.meta
        out = np.full(m.shape, m.fill, m.dtype)
        for r in self.df.collect():
            at = tuple(slice(r[k] * c, min((r[k] + 1) * c, n)) for k, c, n in zip(self.keys, m.chunks, m.shape, strict=True))
            out[at] = np.array(r["payload"], m.dtype).reshape(tuple(s.stop - s.start for s in at), order=m.order)
        return out


def from_cells(cells: DataFrame, meta: ArrayMeta) -> ArrayFrame:
    """Chunk rows from rows ``i0 .., v``: one exchange on the chunk's key. Cells that are missing get the fill value; a
    cell that is there twice is an error when the rows are read."""
    keys = [_div(F.col(f"i{a}"), meta.chunks[a]).alias(f"k{a}") for a in range(meta.ndim)]
    d = cells.select(*keys, *(F.col(f"i{a}") for a in range(meta.ndim)), "v")
    names = [f"k{a}" for a in range(meta.ndim)]
    at = place(meta, [F.col(f"i{a}") for a in range(meta.ndim)], [F.col(n) for n in names]).cast("int")
    d = d.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(at.alias("p"), F.col("v").cast(meta.spark_type).alias("v")))).alias("_c"))
    whole = F.lit(1).cast("long")
    for a, n in enumerate(names):
        whole = whole * width(meta, a, F.col(n))
    places = F.transform("_c", lambda c: c["p"])
    all_there = (F.size("_c") == whole) & (places == F.sequence(F.lit(0), whole.cast("int") - 1))
    full = F.transform("_c", lambda c: c["v"])
    repeated = F.size(F.array_distinct(places)) < F.size("_c")
    refused = F.raise_error(F.lit("a cell of the array occurs more than once")).cast(f"array<{meta.spark_type}>")
    known = F.map_from_entries("_c")
    filled = F.transform(F.sequence(F.lit(0), whole.cast("int") - 1), lambda p: F.coalesce(known[p], F.lit(meta.fill).cast(meta.spark_type)))
    return ArrayFrame(meta, d.select(*names, F.when(all_there, full).when(repeated, refused).otherwise(filled).alias("payload")), lazy=True)


def _fields(meta: ArrayMeta, names: Mapping[str, str]):
    from pyspark.sql import types as T

    cell = {"float": T.FloatType(), "double": T.DoubleType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType()}
    return T.StructType([*(T.StructField(f"k{a}", T.LongType()) for a in range(meta.ndim)), *(T.StructField(n, T.ArrayType(cell[t])) for n, t in names.items())])


def _positions(index: np.ndarray, start: int) -> np.ndarray:
    """Where rows lie in a chunk that begins at ``start``; each row once."""
    at = index - start
    if len(np.unique(at)) != len(at):
        raise ValueError("a cell of the array occurs more than once")
    return at


def from_lists(df: DataFrame, index: str, column: str, meta: ArrayMeta) -> ArrayFrame:
    """A two-dimensional array whose rows are the lists of a table's column, by a dense 0-based index.

    One exchange of whole rows, on the chunk of the index; each range of rows is cut into its chunks as one block. Rows and
    values that are missing or null get the fill value; a row that is there twice is an error.
    """
    d = df.select(_div(F.col(index).cast("long"), meta.chunks[0]).alias("k0"), F.col(index).cast("long").alias("i0"), F.col(column).cast(f"array<{meta.spark_type}>").alias("v"))
    (n, m), (c, w) = meta.shape, meta.chunks

    def cut(table):
        import pyarrow as pa

        k0, lists = table.column("k0")[0].as_py(), table.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = _positions(table.column("i0").to_numpy(), k0 * c)
        block = np.full((min(c, n - k0 * c), m), meta.fill, lists.type.value_type.to_pandas_dtype())
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat, held = lists.flatten(), np.ones(int(sizes.sum()), bool)
        if flat.null_count:
            held = flat.is_valid().to_numpy(zero_copy_only=False)
            flat = flat.fill_null(pa.scalar(0, flat.type) if flat.type != pa.bool_() else False)
        row, place_ = np.repeat(at, sizes), np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held &= place_ < m
        block[row[held], place_[held]] = flat.to_numpy(zero_copy_only=False)[held]
        parts = [block[:, k * w : (k + 1) * w].ravel(order=meta.order) for k in range(meta.grid[1])]
        ends = np.cumsum([0, *map(len, parts)]).astype("i4")
        payload = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), lists.type.value_type))
        return pa.table([pa.array(np.full(len(parts), k0)), pa.array(np.arange(len(parts))), payload], names=["k0", "k1", "payload"])

    return ArrayFrame(meta, d.groupBy("k0").applyInArrow(cut, _fields(meta, {"payload": meta.spark_type})), lazy=True)


def chunk_columns(df: DataFrame, index: str, metas: Mapping[str, ArrayMeta]) -> DataFrame:
    """Rows ``k0`` and, a column for each variable, its payload: all variables of a table in one exchange.

    The variables have one dimension, length and chunk. Rows that are missing and nulls get the fill value.
    """
    one = next(iter(metas.values()))
    (n,), (c,) = one.shape, one.chunks
    d = df.select(_div(F.col(index).cast("long"), c).alias("k0"), F.col(index).cast("long").alias("__i"), *(F.col(v).cast(m.spark_type).alias(v) for v, m in metas.items()))

    def pack(table):
        import pyarrow as pa

        k0 = table.column("k0")[0].as_py()
        at, size, out = _positions(table.column("__i").to_numpy(), k0 * c), min(c, n - k0 * c), [pa.array([k0])]
        for v, m in metas.items():
            column = table.column(v)
            cells = np.full(size, m.fill, column.type.to_pandas_dtype())
            valid = column.is_valid().to_numpy()
            cells[at[valid]] = column.drop_null().to_numpy()
            out.append(pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(cells, column.type)))
        return pa.table(out, names=["k0", *metas])

    return d.groupBy("k0").applyInArrow(pack, _fields(one, {v: m.spark_type for v, m in metas.items()}))


def from_column(df: DataFrame, index: str, column: str, meta: ArrayMeta) -> ArrayFrame:
    """A one-dimensional array from a table's column, by a dense 0-based index."""
    return from_cells(df.select(F.col(index).cast("long").alias("i0"), F.col(column).alias("v")), meta)


def generate(spark: SparkSession, meta: ArrayMeta, value=None) -> ArrayFrame:
    """A lazy array of one value everywhere, or (None) of each cell's row-major position."""
    keys = keys_frame(spark, meta.shape, meta.chunks)
    names = [f"k{a}" for a in range(meta.ndim)]
    cells = F.lit(1).cast("long")
    for a, n in enumerate(names):
        cells = cells * width(meta, a, F.col(n))
    if value is not None:
        payload = F.array_repeat(F.lit(value).cast(meta.spark_type), cells.cast("int"))
    else:
        def at(p):
            rest, index = p.cast("long"), {}
            for a in reversed(range(meta.ndim)) if meta.order == "C" else range(meta.ndim):
                w = width(meta, a, F.col(names[a]))
                index[a] = F.col(names[a]) * meta.chunks[a] + rest % w
                rest = _div(rest, w)
            flat = F.lit(0).cast("long")
            for a in range(meta.ndim):
                flat = flat * meta.shape[a] + index[a]
            return flat.cast(meta.spark_type)

        payload = F.transform(F.sequence(F.lit(0), cells.cast("int") - 1), at)
    return ArrayFrame(meta, keys.select(*names, payload.alias("payload")), lazy=True)


@dataclass
class GroupFrame:
    """Arrays by path, such as ``foo/bar/b``, and the attributes of every group; the root's path is ''."""

    arrays: dict[str, ArrayFrame]
    group_attrs: dict[str, dict] = field(default_factory=dict)
    path: str | None = None

    @property
    def attrs(self) -> dict:
        return self.group_attrs.get("", {})

    def __getitem__(self, name: str) -> ArrayFrame:
        return self.arrays[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.arrays)

    def groups(self) -> list[str]:
        """All groups: those with attributes and those above an array."""
        found = {""} | set(self.group_attrs)
        for name in [*self.arrays, *self.group_attrs]:
            parts = name.split("/")
            found.update("/".join(parts[:k]) for k in range(1, len(parts)))
        return sorted(found)

    def __repr__(self) -> str:
        return f"<GroupFrame {self.path or 'lazy'} arrays={sorted(self.arrays)}>"


@dataclass
class DatasetFrame(GroupFrame):
    """A group whose arrays have named dimensions; ``coords`` names those that label others."""

    coords: tuple[str, ...] = ()
    encoding: dict[str, dict] = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"<DatasetFrame {self.path or 'lazy'} variables={sorted(set(self.arrays) - set(self.coords))} coords={sorted(self.coords)}>"


def from_table(df: DataFrame, index: str, columns: Mapping[str, str], length: int, chunk: int, dim: str = "row", attrs: dict | None = None, staged: str | None = None) -> DatasetFrame:
    """A wide table as a dataset: one one-dimensional variable a column (name to NumPy type), over one dimension.

    The chunks of all variables are made in one exchange. ``staged``: a path for them; each variable then reads
    its own column from there, instead of making the chunks again.
    """
    from ..meta import DIMENSION_KEY

    metas = {c: ArrayMeta((length,), (chunk,), t, attrs={DIMENSION_KEY: [dim]}) for c, t in columns.items()}
    rows = chunk_columns(df, index, metas)
    if staged:
        rows.write.parquet(staged)
        rows = df.sparkSession.read.schema(rows.schema).parquet(staged)
    return DatasetFrame({c: ArrayFrame(m, rows.select("k0", F.col(c).alias("payload")), lazy=True) for c, m in metas.items()}, {"": attrs or {}})


def with_row_index(df: DataFrame, lead: str, order: list[str], span: int = 4096, out: str = "row") -> DataFrame:
    """Number all rows from 0 in the order of ``order``, whose first column ``lead`` is a non-negative whole number.

    Rows are numbered within ranges of ``span`` values of ``lead``, each range beginning where those
    before it end, so no task sorts the whole table (the running total is over one row a range).
    """
    from pyspark.sql import Window

    d = df.withColumn("_r", F.expr(f"{lead} div {span}L"))
    sizes = d.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_g", F.expr("_r div 4096L"))
    large = sizes.groupBy("_g").agg(F.sum("_n").alias("_n"))
    upto = lambda part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    large = large.select("_g", F.coalesce(F.sum("_n").over(upto([F.lit(0)], "_g")), F.lit(0)).alias("_b"))
    sizes = sizes.select("_r", "_g", F.coalesce(F.sum("_n").over(upto(["_g"], "_r")), F.lit(0)).alias("_a")).join(large, "_g").select("_r", (F.col("_a") + F.col("_b")).alias("_before"))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_r").orderBy(*order)))
    return d.join(sizes, "_r").withColumn(out, F.col("_before") + F.col("_i") - 1).drop("_r", "_i", "_before")
