"""The user's interface: ``rechunk`` plans and describes a copy, ``Rechunked.execute`` carries it out."""

from __future__ import annotations

import html
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from .functions.encoding import PACKING, encode_attributes, pack_all
from .functions.geometry import dim_chunks_to_targets, shape_dict_to_tuple
from .meta import DIMENSION_KEY
from .operators.pipeline import ArrayProxy, Copies, CopySpec, executor as named_executor
from .plans.planner import parse_bytes, rechunking_plan
from .sources import files, store, zarr
from .sources.frames import ArrayFrame, DatasetFrame, GroupFrame


class Rechunked:
    """A copy that is planned: the target's description is in its store already, the cells are not."""

    def __init__(self, executor, plan, source, intermediate, target, reopen):
        self._executor, self._plan, self._source, self._intermediate, self._target, self._reopen = executor, plan, source, intermediate, target, reopen

    @property
    def plan(self):
        """What the executor made of it. Spark: the lazy DataFrame of an array's new chunk rows, or a dict of them by array."""
        if isinstance(self._plan, Copies):
            frames = self._plan.frames
            return next(iter(frames.values())) if isinstance(self._source, ArrayFrame) else frames
        return self._plan

    def execute(self, **kwargs):
        """Write the cells and return the target. Can be called again; keyword arguments go to the executor."""
        self._executor.execute_plan(self._plan, **kwargs)
        self._target = self._reopen()
        return self._target

    def _parts(self):
        return [(k, v) for k, v in (("Source", self._source), ("Intermediate", self._intermediate), ("Target", self._target)) if v is not None]

    def __repr__(self) -> str:
        return "<Rechunked>" + "".join(f"\n* {k:<12}: {v!r}\n" for k, v in self._parts())

    def _repr_html_(self) -> str:
        body = lambda v: v._repr_html_() if hasattr(v, "_repr_html_") else f"<p><code>{html.escape(repr(v))}</code></p>"
        return "<h2>Rechunked</h2>" + "".join(f"<details><summary><b>{k}</b></summary>{body(v)}</details>" for k, v in self._parts())


def rechunk(
    source: ArrayFrame | GroupFrame | DatasetFrame, target_chunks, max_mem: int | str, target_store, target_options: dict | None = None, temp_store=None, temp_options: dict | None = None,
    executor: str | Any = "spark", array_name: str | None = None, strict_temp: bool = True, spark: SparkSession | None = None, target_format: str = "parquet",
) -> Rechunked:
    """Plan to write ``source`` to ``target_store`` with other chunks, no block of more than ``max_mem`` bytes.

    ``target_chunks``: for an array a tuple, a dict of every dimension, or None (as they are);
    for a group a dict of arrays, only those named are copied; for a dataset such a dict or one of
    dimensions, all variables are copied. Stores are paths on any file system that Spark reaches, or a
    GroupFrame. A plan that exchanges pieces asks for a ``temp_store`` (its description is put there; the
    pieces themselves go through Spark's shuffle, or with the executor "spark-temp" through that store) unless
    ``strict_temp`` is false. ``target_format``: "parquet" (chunk rows) or "zarr" (version 2 files, a file a chunk). A target or
    temporary store must not be where the source is.
    """
    if target_format not in ("parquet", "zarr"):
        raise ValueError(f"target_format must be parquet or zarr, not {target_format!r}")
    run = named_executor(executor) if isinstance(executor, str) else executor
    max_mem = parse_bytes(max_mem)
    if isinstance(source, (GroupFrame, DatasetFrame)):
        if not isinstance(target_chunks, dict):
            raise ValueError("target_chunks of a group or dataset must be given as a dict")
        if array_name is not None:
            raise ValueError("Can't specify `array_name` when rechunking a group or dataset.")
    elif not isinstance(source, ArrayFrame):
        raise ValueError(f"Source must be an ArrayFrame, a GroupFrame or a DatasetFrame; this is of {type(source)}")
    spark = spark or (source.df.sparkSession if isinstance(source, ArrayFrame) else next(iter(source.arrays.values())).df.sparkSession)
    if temp_options is None:
        temp_options = target_options
    if isinstance(source, ArrayFrame):
        into = isinstance(target_store, GroupFrame)
        if into and array_name is None:
            raise ValueError("Can't rechunk an array into a group without a name for the array.")
        target_path = store.child(_path(target_store), array_name if into else None)
        temp_path = None if temp_store is None else store.child(_path(temp_store), (array_name or "temp") if isinstance(temp_store, GroupFrame) else None)
        _apart(spark, [source], target_path, temp_path)
        spec, temp = _array(spark, source, target_chunks, max_mem, target_path, target_options, temp_path, temp_options, strict_temp, None, target_format)
        return Rechunked(run, run.prepare_plan([spec]), source, temp, spec.write.array, lambda: _stores(target_format).open_array(spark, target_path))

    target_path, temp_path = _path(target_store), None if temp_store is None else _path(temp_store)
    specs, temps, to = [], {}, _stores(target_format)
    _apart(spark, list(source.arrays.values()), target_path, temp_path)
    if isinstance(source, DatasetFrame):
        arrays, chunks, options, temp_options = _dataset(source, target_chunks, target_options)
        to.create_group(spark, target_path, source.attrs | ({"coordinates": " ".join(sorted(source.coords))} if source.coords else {}))
    else:
        missing = [n for n in target_chunks if n not in source.arrays]
        if missing:
            raise KeyError(missing[0])
        arrays, chunks = {n: source.arrays[n] for n in target_chunks}, target_chunks
        options, temp_options = target_options or {}, temp_options or {}
        for g in source.groups():
            to.create_group(spark, store.child(target_path, g), source.group_attrs.get(g))
    if temp_path is not None:
        store.create_group(spark, temp_path)
    for name, a in arrays.items():
        at = None if temp_path is None else store.child(temp_path, name)
        spec, temp = _array(spark, a, chunks[name], max_mem, store.child(target_path, name), options.get(name), at, temp_options.get(name), strict_temp, name, target_format)
        specs.append(spec)
        if temp is not None:
            temps[name] = temp
    if target_format == "zarr":
        to.consolidate(spark, target_path)
    reopen = (lambda: to.open_dataset(spark, target_path)) if isinstance(source, DatasetFrame) else (lambda: to.open_group(spark, target_path))
    target = GroupFrame({s.name: s.write.array for s in specs}, path=target_path)
    return Rechunked(run, run.prepare_plan(specs), source, GroupFrame(temps, path=temp_path) if temps else None, target, reopen)


def _stores(target_format: str):
    return zarr if target_format == "zarr" else store


def _apart(spark: SparkSession, sources: list[ArrayFrame], *paths: str | None) -> None:
    """Refuse to write where a source is: it would be gone before it is read."""
    for path in paths:
        for a in sources:
            if path is not None and a.path and files.same_place(spark, a.path, path):
                raise ValueError(f"{path!r} is where the source is: choose another place")


def _path(of) -> str:
    path = of.path if isinstance(of, (GroupFrame, ArrayFrame)) else str(of)
    if not path:
        raise ValueError("a store needs a path")
    return path.rstrip("/")


def _array(spark, source: ArrayFrame, chunks, max_mem, target_path, target_options, temp_path, temp_options, strict_temp, name=None, target_format="parquet") -> tuple[CopySpec, ArrayFrame | None]:
    """Resolve one array: its wanted chunks, its plan, and the descriptions in target and temporary store."""
    store.validate_options(target_options)
    store.validate_options(temp_options)
    meta = source.meta
    if isinstance(chunks, dict):
        if meta.dims is None:
            raise ValueError(f"sizes by dimension need dimension names (attribute {DIMENSION_KEY!r})")
        try:
            chunks = shape_dict_to_tuple(meta.dims, chunks)
        except KeyError as e:
            raise KeyError(f"target_chunks {chunks} has no size for dimension {e.args[0]!r} of {meta.dims}") from e
    through = chunks is None
    chunks = meta.chunks if through else tuple(int(c) for c in chunks)
    read, piece, write = rechunking_plan(meta.shape, meta.chunks, chunks, meta.itemsize, max_mem, consolidate_reads=not source.lazy)
    made = _stores(target_format).create_array(spark, target_path, meta.with_(chunks=chunks), target_options)
    temp = None
    if not through and read != write and read != piece:
        if temp_path is not None:
            temp = store.create_array(spark, temp_path, meta.with_(chunks=piece, attrs={}), temp_options)
        elif strict_temp:
            raise ValueError("A temporary store location must be provided.")
    return CopySpec(ArrayProxy(source, read), ArrayProxy(temp, piece), ArrayProxy(made, write), dict(target_options or {}), name), temp


def _dataset(source: DatasetFrame, target_chunks: dict, target_options: dict | None):
    """A dataset's variables packed as their encodings say, with their chunks and options."""
    dims = {d for a in source.arrays.values() for d in a.meta.dims or ()}
    own = {n: a.meta.chunks for n, a in source.arrays.items()}
    if all(k in dims for k in target_chunks):
        target_chunks = dim_chunks_to_targets({n: (a.meta.dims, a.meta.shape, a.meta.chunks) for n, a in source.arrays.items()}, target_chunks)
    arrays, chunks, options = {}, {}, {}
    for name, a in source.arrays.items():
        given = dict((target_options or {}).get(name, {}))
        if "chunks" in given:
            raise ValueError(f"Chunks must be provided in 'target_chunks', not among the options of {name!r} ({given['chunks']})")
        encoding = {k: v for k, v in source.encoding.get(name, {}).items() if k != "chunks"} | given
        attrs = encode_attributes(a.attrs)
        packing = {k: encoding[k] for k in PACKING if encoding.get(k) is not None}
        meta = a.meta.with_(attrs=attrs)
        df = a.df
        if packing:
            dtype = np.dtype(packing.get("dtype", meta.dtype)).str
            fill = packing.get("_FillValue", meta.fill)
            meta = meta.with_(dtype=dtype, fill=fill, attrs=attrs | encode_attributes({k: v for k, v in packing.items() if k != "dtype"}))
            df = df.withColumn("payload", pack_all("payload", packing, meta.spark_type))
        arrays[name] = ArrayFrame(meta, df, a.path, lazy=True, name=name)
        chunks[name] = target_chunks.get(name) or own[name]
        options[name] = {k: v for k, v in encoding.items() if k in store.OPTIONS}
    return arrays, chunks, options, options
