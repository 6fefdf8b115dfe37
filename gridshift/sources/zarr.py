"""Version 2 Zarr arrays on any file system that Spark reaches: one file a chunk, ``.zarray`` and ``.zattrs`` beside them."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import encode_attributes
from ..meta import ArrayMeta
from ..operators.regrid import _schema, drop_empty
from . import files
from .frames import ArrayFrame, DatasetFrame, GroupFrame

#: Fixed values of the Blosc 1 container: header length, flags, and the numbers of its inner codecs.
HEADER, SHUFFLED, PLAIN, BIT_SHUFFLED, UNSPLIT = 16, 0x1, 0x2, 0x4, 0x10
INNER = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}
#: What a chunk is packed with if no compressor is named.
DEFAULT = {"id": "zlib", "level": 3}


def _inner(kind: str):
    """A function from packed bytes and their unpacked length to these."""
    if kind == "zlib":
        import zlib

        return lambda raw, n: zlib.decompress(raw)
    if kind in ("lz4", "snappy", "zstd"):
        import pyarrow as pa

        codec = pa.Codec({"lz4": "lz4_raw"}.get(kind, kind))
        return lambda raw, n: codec.decompress(raw, n).to_pybytes()
    raise ValueError(f"Blosc chunks packed with {kind!r} can't be read here")


def unblosc(raw: bytes) -> bytes:
    """The content of a Blosc 1 container."""
    _, _, flags, size, nbytes, block, _ = struct.unpack("<BBBBIII", raw[:HEADER])
    if flags & PLAIN:
        return raw[HEADER : HEADER + nbytes]
    if flags & BIT_SHUFFLED:
        raise ValueError("Blosc chunks with shuffled bits can't be read here")
    unpack = _inner(INNER.get(flags >> 5, str(flags >> 5)))
    count = -(-nbytes // block) if nbytes else 0
    out = []
    for at, first in enumerate(struct.unpack(f"<{count}I", raw[HEADER : HEADER + 4 * count])):
        n = min(block, nbytes - at * block)
        # whole blocks may be packed in as many streams as an item has bytes
        streams = size if not flags & UNSPLIT and n == block and 1 < size <= 16 and n // size >= 128 else 1
        parts = []
        for _ in range(streams):
            (length,) = struct.unpack_from("<i", raw, first)
            body = raw[first + 4 : first + 4 + length]
            parts.append(body if length == n // streams else unpack(body, n // streams))
            first += 4 + length
        whole = b"".join(parts)
        if flags & SHUFFLED and size > 1:
            items = n // size
            whole = np.frombuffer(whole[: items * size], np.uint8).reshape(size, items).T.tobytes() + whole[items * size :]
        out.append(whole)
    return b"".join(out)


def blosc(raw: bytes, size: int, kind: str = "lz4", shuffle: bool = True) -> bytes:
    """A Blosc 1 container with one block and one stream."""
    import pyarrow as pa

    numbers = {v: k for k, v in INNER.items()}
    if kind not in ("lz4", "zstd", "snappy"):
        raise ValueError(f"Blosc chunks can't be packed with {kind!r} here")
    items = len(raw) // size
    shuffle = shuffle and size > 1
    turned = np.frombuffer(raw, np.uint8).reshape(items, size).T.tobytes() if shuffle else raw
    body = pa.Codec({"lz4": "lz4_raw"}.get(kind, kind)).compress(turned).to_pybytes()
    if len(body) >= len(raw):
        return struct.pack("<BBBBIII", 2, 1, PLAIN, size, len(raw), len(raw), HEADER + len(raw)) + raw
    flags = (numbers[kind] << 5) | UNSPLIT | (SHUFFLED if shuffle else 0)
    head = struct.pack("<BBBBIII", 2, 1, flags, size, len(raw), len(raw), HEADER + 8 + len(body))
    return head + struct.pack("<Ii", HEADER + 4, len(body)) + body


def _decoder(compressor: dict | None):
    kind = (compressor or {}).get("id")
    if kind is None:
        return lambda raw: raw
    if kind == "blosc":
        return unblosc
    if kind in ("zlib", "gzip"):
        import zlib

        return lambda raw: zlib.decompress(raw, 47)
    if kind == "zstd":
        import zstandard

        return lambda raw: zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if kind == "bz2":
        import bz2

        return bz2.decompress
    if kind == "lzma":
        import lzma

        return lzma.decompress
    raise ValueError(f"chunks packed with {kind!r} can't be read here")


def _encoder(compressor: dict | None, size: int):
    kind = (compressor or {}).get("id")
    if kind is None:
        return lambda raw: raw
    if kind == "blosc":
        if compressor.get("shuffle", 1) not in (0, 1, -1):
            raise ValueError("Blosc chunks with shuffled bits can't be written here")
        return lambda raw: blosc(raw, size, compressor.get("cname", "lz4"), compressor.get("shuffle", 1) != 0)
    level = compressor.get("level")
    if kind in ("zlib", "gzip"):
        import zlib

        def pack(raw):
            c = zlib.compressobj(1 if level is None else level, wbits=31 if kind == "gzip" else 15)
            return c.compress(raw) + c.flush()

        return pack
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=3 if level is None else level).compress
    if kind == "bz2":
        import bz2

        return lambda raw: bz2.compress(raw, level or 1)
    raise ValueError(f"chunks can't be packed with {kind!r} here")


def _filter(about: dict, stored: np.dtype):
    """A filter's two ways, array to array: the type it leaves, to what is stored, and back."""
    kind = about["id"]
    if kind == "delta":
        kept, seen = np.dtype(about.get("astype", about["dtype"])), np.dtype(about["dtype"])
        put = lambda x: np.concatenate([x[:1], np.diff(x)]).astype(kept)
        return kept, put, lambda x: np.cumsum(x, dtype=seen)
    if kind == "fixedscaleoffset":
        kept, seen = np.dtype(about.get("astype", about["dtype"])), np.dtype(about["dtype"])
        scale, offset = about["scale"], about["offset"]
        return kept, lambda x: np.around((x - offset) * scale).astype(kept), lambda x: (x / scale + offset).astype(seen)
    if kind == "astype":
        kept, seen = np.dtype(about["encode_dtype"]), np.dtype(about["decode_dtype"])
        return kept, lambda x: x.astype(kept), lambda x: x.astype(seen)
    raise ValueError(f"arrays with the filter {kind!r} can't be read or written here")


def _filters(filters: list[dict] | None, stored: np.dtype):
    """What is stored as bytes, and the functions to and from it, through all filters."""
    steps, dtype = [], stored
    for f in filters or []:
        step = _filter(f, dtype)
        steps.append(step)
        dtype = step[0]

    def put(flat):
        for _, to, _ in steps:
            flat = to(flat)
        return flat

    def get(flat):
        for _, _, back in reversed(steps):
            flat = back(flat)
        return flat

    return dtype, put, get


def _arrow(meta: ArrayMeta):
    import pyarrow as pa

    return {"float": pa.float32(), "double": pa.float64(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[meta.spark_type]


def _number(fill):
    return float(fill.replace("Infinity", "inf")) if isinstance(fill, str) else 0 if fill is None else fill


def open_array(spark: SparkSession, path: str) -> ArrayFrame:
    """A lazy array: chunk files are listed by Spark and decoded in the tasks that read them."""
    d = json.loads(files.read_text(spark, f"{path}/.zarray"))
    attrs = json.loads(files.read_text(spark, f"{path}/.zattrs")) if files.exists(spark, f"{path}/.zattrs") else {}
    meta = ArrayMeta(tuple(d["shape"]), tuple(d["chunks"]), d["dtype"], _number(d.get("fill_value")), d.get("order", "C"), attrs)
    sep, compressor, stored = d.get("dimension_separator", "."), d.get("compressor"), np.dtype(d["dtype"])
    kept, _, back = _filters(d.get("filters"), stored)
    _decoder(compressor)
    name = "[0-9]*" + (sep + "[0-9]*") * (meta.ndim - 1)
    raw = spark.read.format("binaryFile").load(f"{path}/{name}") if _any(spark, f"{path}/{name}") else spark.createDataFrame([], "path string, content binary")
    key = F.split(F.regexp_extract("path", r"([0-9]+(?:[./][0-9]+)*)$", 1), r"[./]")
    keys = [key[F.size(key) - meta.ndim + a].cast("long").alias(f"k{a}") for a in range(meta.ndim)]

    def decode(batches):
        import pyarrow as pa

        unpack, cell = _decoder(compressor), _arrow(meta)
        for b in batches:
            for i in range(b.num_rows):
                at = [b.column(a)[i].as_py() for a in range(meta.ndim)]
                whole = back(np.frombuffer(unpack(b.column(meta.ndim)[i].as_py()), kept)).reshape(meta.chunks, order=meta.order)
                cut = whole[tuple(slice(0, min(c, n - k * c)) for k, c, n in zip(at, meta.chunks, meta.shape, strict=True))]
                flat = pa.array(cut.ravel(order=meta.order).astype(cell.to_pandas_dtype()), cell)
                yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in at), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=[*(f"k{a}" for a in range(meta.ndim)), "payload"])

    return ArrayFrame(meta, raw.select(*keys, "content").mapInArrow(decode, _schema(meta)), path, lazy=True, name=path.rstrip("/").rsplit("/", 1)[-1], format="zarr")


def _any(spark: SparkSession, pattern: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def open_group(spark: SparkSession, path: str) -> GroupFrame:
    """All arrays and group attributes below a path."""
    arrays, attrs, todo = {}, {}, [""]
    while todo:
        at = todo.pop()
        here = f"{path}/{at}".rstrip("/")
        if files.exists(spark, f"{here}/.zarray"):
            arrays[at] = open_array(spark, here)
            continue
        if files.exists(spark, f"{here}/.zattrs"):
            attrs[at] = json.loads(files.read_text(spark, f"{here}/.zattrs"))
        todo += [f"{at}/{n}" if at else n for n in files.folders(spark, here)]
    return GroupFrame(dict(sorted(arrays.items())), attrs, path)


def open_dataset(spark: SparkSession, path: str) -> DatasetFrame:
    """A group of arrays with named dimensions, its packed variables unpacked."""
    from .store import as_dataset

    return as_dataset(open_group(spark, path))


def create_array(spark: SparkSession, path: str, meta: ArrayMeta, options: dict | None = None) -> ArrayFrame:
    """An empty array: its description is there at once. ``compressor``: as in a ``.zarray``, or a name; ``filters`` as there."""
    options = options or {}
    if files.exists(spark, f"{path}/.zarray"):
        if not options.get("overwrite"):
            raise ValueError(f"path {path!r} contains an array")
        files.delete(spark, path)
    compressor = options.get("compressor", DEFAULT)
    compressor = {"id": compressor} if isinstance(compressor, str) else compressor
    meta = meta.with_(order=options.get("order", meta.order), attrs=encode_attributes(meta.attrs))
    _encoder(compressor, meta.itemsize)
    _filters(options.get("filters"), np.dtype(meta.dtype))
    fill = meta.fill
    if isinstance(fill, float) and not np.isfinite(fill):
        fill = "NaN" if fill != fill else "Infinity" if fill > 0 else "-Infinity"
    about = {"zarr_format": 2, "shape": meta.shape, "chunks": meta.chunks, "dtype": meta.dtype, "fill_value": fill, "order": meta.order, "filters": options.get("filters"), "compressor": compressor}
    files.write_text(spark, f"{path}/.zarray", json.dumps(about))
    files.write_text(spark, f"{path}/.zattrs", json.dumps(meta.attrs))
    empty = spark.createDataFrame([], _schema(meta))
    return ArrayFrame(meta, empty, path, format="zarr")


def create_group(spark: SparkSession, path: str, attrs: dict | None = None) -> None:
    """A group's folder; attributes are added to those that it has."""
    at = f"{path}/.zattrs"
    old = json.loads(files.read_text(spark, at)) if files.exists(spark, at) else {}
    files.write_text(spark, f"{path}/.zgroup", json.dumps({"zarr_format": 2}))
    files.write_text(spark, at, json.dumps(old | encode_attributes(attrs or {})))


def consolidate(spark: SparkSession, path: str) -> None:
    """All descriptions below a group in one file, ``.zmetadata``, for readers that list no folders."""
    found, todo = {}, [""]
    while todo:
        at = todo.pop()
        here = f"{path}/{at}".rstrip("/")
        for name in (".zgroup", ".zarray", ".zattrs"):
            if files.exists(spark, f"{here}/{name}"):
                found[f"{at}/{name}".lstrip("/")] = json.loads(files.read_text(spark, f"{here}/{name}"))
        if not files.exists(spark, f"{here}/.zarray"):
            todo += [f"{at}/{n}" if at else n for n in files.folders(spark, here)]
    files.write_text(spark, f"{path}/.zmetadata", json.dumps({"metadata": found, "zarr_consolidated_format": 1}))


def write_cells(array: ArrayFrame, path: str, options: dict | None = None) -> None:
    """The chunk rows as chunk files, as ``path``'s description says; each task writes its own chunks, whole ones.

    Chunk files are replaced whole, so a retried task does no harm. Unless ``write_empty_chunks`` is false, chunks of fill value
    are written as well.
    """
    spark = array.df.sparkSession
    d = json.loads(files.read_text(spark, f"{path}/.zarray"))
    if (options or {}).get("write_empty_chunks") is False:
        array = drop_empty(array)
    meta, stored = array.meta, np.dtype(d["dtype"])
    fill, compressor = _number(d["fill_value"]), d["compressor"]
    kept, forth, _ = _filters(d.get("filters"), stored)

    def put(batches):
        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path)
        pack, n = _encoder(compressor, kept.itemsize), 0
        for b in batches:
            for i in range(b.num_rows):
                at = [b.column(a)[i].as_py() for a in range(meta.ndim)]
                size = [min(c, n_ - k * c) for k, c, n_ in zip(at, meta.chunks, meta.shape, strict=True)]
                whole = np.full(meta.chunks, fill, stored)
                whole[tuple(map(slice, size))] = b.column(meta.ndim)[i].values.to_numpy(zero_copy_only=False).reshape(size, order=meta.order)
                raw = forth(whole.ravel(order=meta.order)).astype(kept).tobytes()
                with where.open_output_stream(f"{root}/{'.'.join(map(str, at))}") as out:
                    out.write(pack(raw))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    array.df.select(*array.keys, "payload").mapInArrow(put, "n long").collect()  # one count a task


def write_array(array: ArrayFrame, path: str, level: int | None = 3, **options) -> None:
    """An array as Zarr files. ``level``: of zlib; None stores plain bytes; or give a ``compressor`` and ``filters``."""
    options = {"compressor": None if level is None else {"id": "zlib", "level": level}} | options
    create_array(array.df.sparkSession, path, array.meta, options)
    write_cells(array, path, options)
