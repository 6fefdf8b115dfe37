"""Stores: a folder for each array with its description and Parquet files of chunk rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..functions.encoding import encode_attributes
from ..meta import ArrayMeta
from ..operators.regrid import drop_empty
from . import files
from .frames import ArrayFrame, DatasetFrame, GroupFrame

ARRAY, GROUP, DATA = ".array.json", ".group.json", "data"

#: Options of a new array.
OPTIONS = ["compressor", "filters", "order", "cache_metadata", "cache_attrs", "overwrite", "write_empty_chunks"]


def validate_options(options: dict | None) -> None:
    for o in options or {}:
        if o not in OPTIONS:
            raise ValueError(f"Zarr options must not include {o} (it was given as {options[o]!r}); there are: {', '.join(OPTIONS)}")


def child(path: str, name: str | None) -> str:
    return f"{path.rstrip('/')}/{name}" if name else path.rstrip("/")


def create_array(spark: SparkSession, path: str, meta: ArrayMeta, options: dict | None = None) -> ArrayFrame:
    """An empty array in a store: its description is there at once, its cells once they are written."""
    options = options or {}
    if files.exists(spark, f"{path}/{ARRAY}"):
        if not options.get("overwrite"):
            raise ValueError(f"path {path!r} contains an array")
        files.delete(spark, path)
    meta = meta.with_(order=options.get("order", meta.order), attrs=encode_attributes(meta.attrs))
    files.write_text(spark, f"{path}/{ARRAY}", meta.to_json())
    return ArrayFrame(meta, _rows(spark, meta, path), path)


def _rows(spark: SparkSession, meta: ArrayMeta, path: str) -> DataFrame:
    schema = ", ".join(f"k{a} long" for a in range(meta.ndim)) + f", payload array<{meta.spark_type}>"
    if not files.exists(spark, f"{path}/{DATA}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{DATA}")


def open_array(spark: SparkSession, path: str) -> ArrayFrame:
    meta = ArrayMeta.from_json(files.read_text(spark, f"{path}/{ARRAY}"))
    return ArrayFrame(meta, _rows(spark, meta, path), path, name=path.rstrip("/").rsplit("/", 1)[-1])


def write_cells(array: ArrayFrame, path: str, options: dict | None = None, **writer) -> None:
    """Chunk rows as Parquet; a run again replaces them (the commit protocol makes retried tasks harmless)."""
    options = options or {}
    if options.get("filters"):
        raise ValueError("cells in Parquet have no filters; Zarr targets do")
    if options.get("write_empty_chunks") is False:
        array = drop_empty(array)
    codec = options.get("compressor", "snappy")
    array.df.write.mode("overwrite").options(compression="none" if codec is None else str(codec), **writer).parquet(f"{path}/{DATA}")


def create_group(spark: SparkSession, path: str, attrs: dict | None = None) -> None:
    """A group's folder; attributes are added to those that it has."""
    at = f"{path}/{GROUP}"
    old = json.loads(files.read_text(spark, at)) if files.exists(spark, at) else {}
    files.write_text(spark, at, json.dumps(old | encode_attributes(attrs or {})))


def open_group(spark: SparkSession, path: str) -> GroupFrame:
    """A group with everything below it."""
    arrays, attrs, todo = {}, {}, [""]
    while todo:
        at = todo.pop()
        here = child(path, at)
        if files.exists(spark, f"{here}/{ARRAY}"):
            arrays[at] = open_array(spark, here)
            continue
        if files.exists(spark, f"{here}/{GROUP}"):
            attrs[at] = json.loads(files.read_text(spark, f"{here}/{GROUP}"))
        todo += [f"{at}/{name}" if at else name for name in files.folders(spark, here)]
    return GroupFrame(dict(sorted(arrays.items())), attrs, path)


def save_array(array: ArrayFrame, path: str, options: dict | None = None) -> ArrayFrame:
    """A lazy array put into a store."""
    spark = array.df.sparkSession
    validate_options(options)
    made = create_array(spark, path, array.meta, options)
    if made.meta.order != array.meta.order:
        from ..operators.regrid import copy

        array = copy(array, made.meta)
    write_cells(array, path, options)
    return open_array(spark, path)


def save_group(group: GroupFrame, path: str, options: dict | None = None, spark: SparkSession | None = None) -> GroupFrame:
    spark = spark or next(iter(group.arrays.values())).df.sparkSession
    for g in group.groups():
        create_group(spark, child(path, g), group.group_attrs.get(g))
    for name, a in group.arrays.items():
        save_array(a, child(path, name), options)
    return open_group(spark, path)


def open_dataset(spark: SparkSession, path: str, decode: bool = True) -> DatasetFrame:
    """A group of named-dimension arrays as a dataset, its packed variables unpacked."""
    return as_dataset(open_group(spark, path), decode)


def as_dataset(g: GroupFrame, decode: bool = True) -> DatasetFrame:
    from ..functions.encoding import unpack_all

    coords = tuple(str(g.attrs.get("coordinates", "")).split())
    arrays = {}
    for name, a in g.arrays.items():
        packed = {k: a.attrs[k] for k in ("scale_factor", "add_offset", "_FillValue") if k in a.attrs}
        if decode and packed:
            meta = a.meta.with_(dtype="f8", fill=float("nan") if "_FillValue" in packed else a.meta.fill, attrs={k: v for k, v in a.attrs.items() if k not in packed})
            a = ArrayFrame(meta, a.df.withColumn("payload", unpack_all("payload", packed)), path=a.path, lazy=True)
        arrays[name] = a
    return DatasetFrame(arrays, {k: {n: v for n, v in attrs.items() if n != "coordinates"} for k, attrs in g.group_attrs.items()}, g.path, coords)
