"""Registered queries over the test tables, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import rechunk
from ..functions import geometry
from ..functions.encoding import pack, unpack
from ..meta import ArrayMeta
from ..operators import pipeline as pipelines
from ..operators import regrid as R
from ..sources import files, frames, store, zarr
from ..sources.frames import ArrayFrame, GroupFrame
from . import planner

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIMS = 64


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark, sf_dir, chunks=(50, DIMS), **more) -> ArrayFrame:
    """The embeddings as a two-dimensional array of f4, lazily."""
    t = table(spark, sf_dir, "embeddings")
    n = t.agg(F.max("vec_id")).first()[0] + 1
    return frames.from_lists(t, "vec_id", "embedding", ArrayMeta((n, DIMS), chunks, "f4", **more))


def summary(a: ArrayFrame) -> DataFrame:
    """A row a chunk: its key, cells, least and largest value, and the first and last in order."""
    return a.df.select(*a.keys, F.size("payload").cast("long").alias("cells"), F.array_min("payload").alias("vmin"), F.array_max("payload").alias("vmax"), F.element_at("payload", 1).alias("vfirst"), F.element_at("payload", -1).alias("vlast"))


CELLS = "WITH c AS (SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, unnest(embedding) AS v FROM embeddings) "
SUMMARY = "SELECT i0 // {0} AS k0, i1 // {1} AS k1, count(*) AS cells, min(v) AS vmin, max(v) AS vmax, first(v ORDER BY i0, i1) AS vfirst, last(v ORDER BY i0, i1) AS vlast FROM c GROUP BY 1, 2"
ALL = "SELECT i0, i1, v FROM c"


@query(CELLS + ALL)
def array_cells(spark, sf_dir):
    """An array's cells, from chunk rows."""
    return embeddings(spark, sf_dir).cells()


@query(CELLS + SUMMARY.format(500, 8))
def rechunk_summary(spark, sf_dir):
    """Row chunks to column chunks through the planned exchange."""
    a = embeddings(spark, sf_dir)
    target = (min(500, a.meta.shape[0]), 8)
    _, _, write = planner.rechunking_plan(a.meta.shape, a.meta.chunks, target, a.meta.itemsize, 64_000)
    return summary(R.regrid(a, target, write))


@query(CELLS + SUMMARY.format(500, 8))
def rechunk_by_cells(spark, sf_dir):
    """The same in generated code only, a row a cell."""
    a = embeddings(spark, sf_dir)
    return summary(R.by_cells(a, a.meta.with_(chunks=(500, 8))))


@query(CELLS + ALL)
def rechunk_roundtrip(spark, sf_dir):
    """To another grid and back."""
    return R.regrid(R.regrid(embeddings(spark, sf_dir), (500, 8)), (50, DIMS)).cells()


@query(CELLS + SUMMARY.format(60, 7))
def rechunk_ragged(spark, sf_dir):
    """A grid that divides neither axis."""
    return summary(R.regrid(embeddings(spark, sf_dir), (60, 7)))


@query(CELLS + SUMMARY.format(10, 16))
def rechunk_split_only(spark, sf_dir):
    """A refinement: no exchange."""
    return summary(R.regrid(embeddings(spark, sf_dir), (10, 16)))


@query(CELLS + "SELECT i0 // 50 AS s0, i1 // 64 AS s1, i0 // 500 AS t0, i1 // 8 AS t1, count(*) AS cells FROM c GROUP BY ALL")
def rechunk_fragments(spark, sf_dir):
    """The pieces that two grids make of an array."""
    a = embeddings(spark, sf_dir)
    return R.fragments(a, a.meta.with_(chunks=(500, 8)))


@query(CELLS + ALL)
def multistage_roundtrip(spark, sf_dir):
    """The plan for a least and a most memory, carried out: to column chunks, as tall as the most memory holds."""
    a, most = embeddings(spark, sf_dir, (20, DIMS)), 20_480
    return R.regrid_in_stages(a, (min(most // a.meta.itemsize, a.meta.shape[0]), 1), 256, most).cells()


@query(CELLS + SUMMARY.format(50, 64))
def passthrough_copy(spark, sf_dir):
    """The same grid: rows go through."""
    return summary(R.regrid(embeddings(spark, sf_dir), (50, DIMS)))


@query(CELLS + "SELECT i0, i1, v FROM c WHERE i0 >= 150 AND i0 < 230 AND i1 >= 5 AND i1 < 20")
def slice_chunk(spark, sf_dir):
    """A box of cells from a store; the ranges of chunk keys reach the scan."""
    a = store.save_array(embeddings(spark, sf_dir, (50, 8)), files.scratch(spark, "slice"))
    return a.read(slice(150, 230), slice(5, 20))


@query(CELLS + "SELECT i0 // 50 AS k0, i1 // 8 AS k1, (i1 % 8) * least(50, (SELECT max(vec_id) + 1 FROM embeddings) - (i0 // 50) * 50) + i0 % 50 AS p, v FROM c")
def order_f_payload(spark, sf_dir):
    """Payloads in Fortran order."""
    a = R.regrid(embeddings(spark, sf_dir), (50, 8), order="F")
    return a.df.select("k0", "k1", F.posexplode("payload").alias("p", "v")).withColumn("p", F.col("p").cast("long"))


@query("SELECT a.k AS k0, b.k AS k1, a.k * 60 AS start0, least((a.k + 1) * 60, 500) AS stop0, b.k * 7 AS start1, least((b.k + 1) * 7, 64) AS stop1 FROM (SELECT unnest(range(9)) AS k) a, (SELECT unnest(range(10)) AS k) b")
def chunk_keys(spark, sf_dir):
    """The keys of a ragged grid."""
    return geometry.keys_frame(spark, (500, 64), (60, 7)).select("k0", "k1", "start0", "stop0", "start1", "stop1")


@query("SELECT vec_id // 60 AS k0, count(*) AS owned, count(DISTINCT vec_id) AS cells FROM embeddings GROUP BY 1")
def chunk_owner(spark, sf_dir):
    """Each cell of an axis lies in one key's range."""
    t = table(spark, sf_dir, "embeddings").select("vec_id")
    n = t.agg(F.max("vec_id")).first()[0] + 1
    keys = geometry.keys_frame(spark, (n,), (60,))
    owned = t.withColumn("k0", F.expr("vec_id div 60L")).join(keys, "k0").where("vec_id >= start0 and vec_id < stop0")
    return owned.groupBy("k0").agg(F.count("*").alias("owned"), F.countDistinct("vec_id").alias("cells"))


#: Lengths, chunks and other chunks of an axis.
GRIDS = [(6, 1, 6), (10, 1, 6), (6, 2, 3), (24, 2, 3), (10, 4, 5), (100, 4, 5), (100, 43, 100), (100, 43, 51), (100, 43, 40), (100, 43, 10), (100, 43, 1), (20, 5, 7), (2000, 50, 500)]


@query("SELECT n, s, t, CAST((SELECT count(DISTINCT (i // s, i // t)) FROM range(n) r(i)) AS BIGINT) AS ops FROM (VALUES " + ", ".join(f"({n}, {s}, {t})" for n, s, t in GRIDS) + ") g(n, s, t)")
def io_ops(spark, sf_dir):
    """Pieces that two grids cut an axis into."""
    return spark.createDataFrame([(n, s, t, planner.count_intermediate_chunks(s, t, n)) for n, s, t in GRIDS], "n int, s int, t int, ops long")


@query("SELECT * FROM (VALUES (0, 20, 4, 4), (1, 5, 25, 5), (2, 7, 7, 7), (3, 1, 64, 1)) t(axis, r, w, shared)")
def shared_chunks(spark, sf_dir):
    """What fits into both grids, as the planner says."""
    r, w = (20, 5, 7, 1), (4, 25, 7, 64)
    return spark.createDataFrame([(k, *x) for k, x in enumerate(zip(r, w, planner.shared_chunks(r, w), strict=True))], "axis int, r int, w int, shared int")


#: Grids (shape, chunks, other chunks) of two axes.
PLANES = [((10, 12), (4, 3), (5, 12)), ((100, 7), (43, 7), (10, 2)), ((6, 6), (6, 6), (6, 6)), ((50, 64), (7, 64), (50, 9))]


@query("SELECT id, CAST((SELECT count(DISTINCT (i // s0, i // t0)) FROM range(n0) r(i)) * (SELECT count(DISTINCT (j // s1, j // t1)) FROM range(n1) q(j)) AS BIGINT) AS ops FROM (VALUES " + ", ".join(f"({k}, {', '.join(str(x) for axis in zip(*g) for x in axis)})" for k, g in enumerate(PLANES)) + ") g(id, n0, s0, t0, n1, s1, t1)")
def plane_io_ops(spark, sf_dir):
    """Pieces that two grids cut a plane into: the product over its axes."""
    return spark.createDataFrame([(k, planner.calculate_single_stage_io_ops(*g)) for k, g in enumerate(PLANES)], "id int, ops long")


@query("SELECT * FROM (VALUES ('8', 1, 2), ('16', 1, 4), ('17', 1, 4), ('64', 2, 8), ('256', 8, 8), ('512', 8, 8)) t(mem, c0, c1)")
def consolidate_vectors(spark, sf_dir):
    """Chunks (1, 2) of an (8, 8) array of four-byte cells, grown to several budgets."""
    return spark.createDataFrame([(str(m), *planner.consolidate_chunks((8, 8), (1, 2), 4, m)) for m in (8, 16, 17, 64, 256, 512)], "mem string, c0 int, c1 int")


@query("SELECT * FROM (VALUES (32, 0, 1, 1, 8), (32, 1, 8, 1, 1), (64, 0, 2, 2, 8), (64, 1, 8, 2, 2), (256, 0, 8, 8, 8), (256, 1, 8, 8, 8)) t(mem, axis, r, i, w)")
def plan_table(spark, sf_dir):
    """Single-stage plans of (1, 8) to (8, 1)."""
    out = []
    for m in (32, 64, 256):
        out += [(m, a, *x) for a, x in enumerate(zip(*planner.rechunking_plan((8, 8), (1, 8), (8, 1), 4, m), strict=True))]
    return spark.createDataFrame(out, "mem int, axis int, r int, i int, w int")


@query("SELECT * FROM (VALUES (0, 0, 100, 10, 10), (0, 1, 1, 1, 10), (1, 0, 10, 1, 1), (1, 1, 10, 10, 100)) t(stage, axis, r, i, w)")
def multistage_plan(spark, sf_dir):
    """A plan of two stages."""
    plan = planner.multistage_rechunking_plan((100, 100), (100, 1), (1, 100), 1, 10, 100)
    return planner.plan_frame(spark, plan).select("stage", "axis", *(F.col(a).cast("int").alias(b) for a, b in (("read", "r"), ("inter", "i"), ("write", "w"))))


@query("SELECT * FROM (VALUES ('aaa', 0, 10), ('aaa', 1, 180), ('aaa', 2, 365), ('lat', 0, 180), ('lon', 0, 10), ('time', 0, 365)) t(variable, axis, c)")
def dims_to_chunks(spark, sf_dir):
    """Chunks by dimension, for each variable."""
    sizes = {"lon": 360, "lat": 180, "time": 365}
    variables = {"aaa": (("lon", "lat", "time"), (360, 180, 365), None)} | {d: ((d,), (n,), None) for d, n in sizes.items()}
    got = geometry.dim_chunks_to_targets(variables, {"lon": 10, "time": 5_000, "lat": -1})
    return spark.createDataFrame([(v, a, c) for v, cs in got.items() for a, c in enumerate(cs)], "variable string, axis int, c int")


@query("SELECT event_id // 1500 AS k0, count(*) AS cells, min(value) AS vmin, max(value) AS vmax, first(value ORDER BY event_id) AS vfirst, last(value ORDER BY event_id) AS vlast FROM events GROUP BY 1")
def events_1d(spark, sf_dir):
    """A one-dimensional array, in a direct copy."""
    t = table(spark, sf_dir, "events")
    n = t.agg(F.max("event_id")).first()[0] + 1
    return summary(R.regrid(frames.from_column(t, "event_id", "value", ArrayMeta((n,), (1000,), "f8")), (1500,)))


@query("""SELECT 'events/value' AS "array", event_id // 700 AS k0, count(*) AS cells, min(value) AS vmin, max(value) AS vmax FROM events GROUP BY 2
UNION ALL SELECT 'label', vec_id // 64, count(*), CAST(min(label) AS DOUBLE), CAST(max(label) AS DOUBLE) FROM embeddings GROUP BY 2""")
def group_rechunk(spark, sf_dir):
    """A group of arrays under nested paths, in one plan."""
    v, e = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")
    n, m = v.agg(F.max("vec_id")).first()[0] + 1, e.agg(F.max("event_id")).first()[0] + 1
    g = GroupFrame({"label": frames.from_column(v, "vec_id", "label", ArrayMeta((n,), (50,), "i4")), "events/value": frames.from_column(e, "event_id", "value", ArrayMeta((m,), (1000,), "f8"))})
    at = files.scratch(spark, "group")
    t = rechunk(g, {"label": (64,), "events/value": (700,)}, "8KB", f"{at}/target", temp_store=f"{at}/temp").execute()
    out = None
    for name, a in t.arrays.items():
        s = summary(a).select(F.lit(name).alias("array"), "k0", "cells", F.col("vmin").cast("double").alias("vmin"), F.col("vmax").cast("double").alias("vmax"))
        out = s if out is None else out.unionByName(s)
    return out


ROWS = "WITH r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS i FROM lineitem) "
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def rows_of_lineitem(spark, sf_dir) -> DataFrame:
    return frames.with_row_index(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])


@query(ROWS + " UNION ALL ".join(f"SELECT '{m}' AS variable, i // 2500 AS k0, count(*) AS cells, min({m}) AS vmin, max({m}) AS vmax, first({m} ORDER BY i) AS vfirst, last({m} ORDER BY i) AS vlast FROM r GROUP BY 2" for m in MEASURES))
def dataset_rechunk(spark, sf_dir):
    """A wide table as a dataset; all its variables on a new grid, by its one dimension. Rows are numbered and packed into chunks
    once; each variable reads its own column of the staged chunks."""
    at, n = files.scratch(spark, "dataset"), table(spark, sf_dir, "lineitem").count()
    d = frames.from_table(rows_of_lineitem(spark, sf_dir).select("row", *MEASURES), "row", dict.fromkeys(MEASURES, "f8"), n, 1000, staged=f"{at}/chunks")
    made = rechunk(d, {"row": 2500}, "1MB", f"{at}/target", strict_temp=False).execute()
    out = None
    for name, a in made.arrays.items():
        s = summary(a).select(F.lit(name).alias("variable"), "k0", "cells", "vmin", "vmax", "vfirst", "vlast")
        out = s if out is None else out.unionByName(s)
    return out


PACKING = {"scale_factor": 0.01, "_FillValue": -9999, "dtype": "i4"}
GAPS = "CASE WHEN o_orderkey % 10 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END"


def _gappy(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i0"), F.when(F.col("o_orderkey") % 10 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("v"))


@query("SELECT o_orderkey AS i0, CASE WHEN o_orderkey % 10 = 0 THEN -9999 ELSE CAST(round_even(o_totalprice / 0.01::DOUBLE, 0) AS INTEGER) END AS v FROM orders")
def cf_pack(spark, sf_dir):
    """Values packed into whole numbers, gaps as a fill value."""
    return _gappy(spark, sf_dir).select("i0", pack(F.col("v"), PACKING, "int").alias("v"))


@query("SELECT o_orderkey AS i0, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(round_even(o_totalprice / 0.01::DOUBLE, 0) AS INTEGER) * 0.01::DOUBLE END AS v FROM orders")
def cf_unpack(spark, sf_dir):
    """And back; the gaps are shown as nulls."""
    packed = _gappy(spark, sf_dir).select("i0", pack(F.col("v"), PACKING, "int").alias("v"))
    return packed.select("i0", unpack(F.col("v"), PACKING).alias("v")).withColumn("v", F.nullif(F.nanvl("v", F.lit(-1.0)), F.lit(-1.0)))


@query("WITH s AS (SELECT vec_id AS i, CASE WHEN vec_id // 20 % 3 = 0 THEN 0 ELSE label END AS v FROM embeddings) SELECT i // 20 AS k0, count(*) AS cells, CAST(sum(v) AS BIGINT) AS total FROM s GROUP BY 1 HAVING NOT bool_and(v = 0)")
def empty_chunk_drop(spark, sf_dir):
    """Chunks of fill value only are not stored."""
    t = table(spark, sf_dir, "embeddings").withColumn("v", F.when(F.expr("vec_id div 20 % 3 = 0"), 0).otherwise(F.col("label")))
    n = t.agg(F.max("vec_id")).first()[0] + 1
    a = R.drop_empty(frames.from_column(t, "vec_id", "v", ArrayMeta((n,), (20,), "i4")))
    return a.df.select("k0", F.size("payload").cast("long").alias("cells"), F.aggregate("payload", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("WITH g AS (SELECT unnest(range(40)) AS i0), h AS (SELECT unnest(range(33)) AS i1) SELECT i0, i1, CAST(i0 * 33 + i1 AS DOUBLE) AS v FROM g, h")
def generated_cells(spark, sf_dir):
    """A generated array on two grids."""
    return R.regrid(frames.generate(spark, ArrayMeta((40, 33), (7, 10), "f8")), (11, 4)).cells()


@query(CELLS + ALL)
def rechunk_store(spark, sf_dir):
    """The whole way: an array in a store, planned, copied to another store, and read from there."""
    at = files.scratch(spark, "store")
    a = store.save_array(embeddings(spark, sf_dir), f"{at}/source")
    return rechunk(a, (min(500, a.meta.shape[0]), 8), "64KB", f"{at}/target", temp_store=f"{at}/temp").execute().cells()


@query(CELLS + ALL)
def zarr_rechunk(spark, sf_dir):
    """From Zarr files (Blosc) to Zarr files (zstd) on another grid, through the temporary store, and read from there."""
    at = files.scratch(spark, "zarr")
    zarr.write_array(embeddings(spark, sf_dir), f"{at}/source", compressor={"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1})
    a = zarr.open_array(spark, f"{at}/source")
    plan = rechunk(a, (min(500, a.meta.shape[0]), 8), "64KB", f"{at}/target", {"compressor": {"id": "zstd", "level": 3}}, f"{at}/temp", {}, executor="spark-temp", target_format="zarr")
    return plan.execute().cells()


@query("SELECT * FROM (VALUES ('', 'title', '\"root\"'), ('deep', 'n', '3'), ('deep/a', '_ARRAY_DIMENSIONS', '[\"x\"]'), ('deep/a', 'unit', '\"m\"')) t(node, attribute, value)")
def group_attributes(spark, sf_dir):
    """Attributes of groups and arrays come along."""
    at = files.scratch(spark, "attributes")
    a = frames.generate(spark, ArrayMeta((6,), (2,), "f8", attrs={"_ARRAY_DIMENSIONS": ["x"], "unit": "m"}))
    rechunk(GroupFrame({"deep/a": a}, {"": {"title": "root"}, "deep": {"n": 3}}), {"deep/a": (3,)}, 100, f"{at}/target", strict_temp=False).execute()
    g = store.open_group(spark, f"{at}/target")
    found = {**g.group_attrs, **{n: a.attrs for n, a in g.arrays.items()}}
    return spark.createDataFrame([(n, k, json.dumps(v)) for n, attrs in found.items() for k, v in attrs.items()], "node string, attribute string, value string")


@query(CELLS + "SELECT i0, i1, v FROM c WHERE i0 < 20")
def overwrite_target(spark, sf_dir):
    """A target that holds another array is replaced if that is asked for; chunks are given by dimension."""
    at = files.scratch(spark, "overwrite")
    rechunk(frames.generate(spark, ArrayMeta((9, 9), (3, 9), "f4")), (3, 3), 4000, f"{at}/target").execute()
    few = frames.from_lists(table(spark, sf_dir, "embeddings").where("vec_id < 20"), "vec_id", "embedding", ArrayMeta((20, DIMS), (20, DIMS), "f4", attrs={"_ARRAY_DIMENSIONS": ["row", "part"]}))
    return rechunk(few, {"row": 10, "part": 16}, "64KB", f"{at}/target", {"overwrite": True}, strict_temp=False).execute().cells()


@query(CELLS + "SELECT i0, i1, CAST(round_even(v::DOUBLE * 100, 0) AS BIGINT) / 100::DOUBLE AS v FROM c WHERE i0 < 64")
def zarr_filters(spark, sf_dir):
    """Cells kept as two-byte numbers by a filter, and read back."""
    few = table(spark, sf_dir, "embeddings").where("vec_id < 64")
    a = frames.from_lists(few, "vec_id", "embedding", ArrayMeta((64, DIMS), (16, DIMS), "f8"))
    at = f"{files.scratch(spark, 'filters')}/array"
    zarr.write_array(a, at, filters=[{"id": "fixedscaleoffset", "scale": 100, "offset": 0, "dtype": "<f8", "astype": "<i2"}])
    return zarr.open_array(spark, at).cells()


@query("SELECT * FROM (VALUES ('1KB', 1000), ('1.5 MB', 1500000), ('2GiB', 2147483648), ('64 kib', 65536), ('100', 100)) t(said, bytes)")
def memory_limits(spark, sf_dir):
    """Limits as text, in bytes."""
    said = ("1KB", "1.5 MB", "2GiB", "64 kib", "100")
    return spark.createDataFrame([(s, planner.parse_bytes(s)) for s in said], "said string, bytes long")


@query(CELLS + ALL + " WHERE i0 < 40")
def local_executor(spark, sf_dir):
    """The executor that copies on the driver, by its registered name."""
    at = files.scratch(spark, "local")
    few = frames.from_lists(table(spark, sf_dir, "embeddings").where("vec_id < 40"), "vec_id", "embedding", ArrayMeta((40, DIMS), (40, DIMS), "f4"))
    return rechunk(few, (7, 16), "64KB", f"{at}/target", strict_temp=False, executor="local").execute().cells()


@query(CELLS + "SELECT i0, i1, v FROM c WHERE i0 < 80")
def planned_rows(spark, sf_dir):
    """The lazy DataFrame that a plan is, before anything is written."""
    at = files.scratch(spark, "plan")
    few = frames.from_lists(table(spark, sf_dir, "embeddings").where("vec_id < 80"), "vec_id", "embedding", ArrayMeta((80, DIMS), (20, DIMS), "f4"))
    made = rechunk(few, (80, 4), "64KB", f"{at}/target", strict_temp=False)
    return ArrayFrame(few.meta.with_(chunks=(80, 4)), made.plan).cells()


@query("SELECT 'label' AS \"array\", vec_id // 64 AS k0, count(*) AS cells, CAST(sum(label) AS BIGINT) AS total FROM embeddings GROUP BY 2 UNION ALL SELECT 'first/copy', vec_id // 33, count(*), CAST(sum(label) AS BIGINT) FROM embeddings GROUP BY 2")
def into_group(spark, sf_dir):
    """Arrays copied one by one into a group that is there already, under names of their own; None keeps the chunks."""
    v = table(spark, sf_dir, "embeddings")
    n = v.agg(F.max("vec_id")).first()[0] + 1
    a = frames.from_column(v, "vec_id", "label", ArrayMeta((n,), (64,), "i4"))
    at = files.scratch(spark, "into")
    store.create_group(spark, f"{at}/group", {"title": "labels"})
    into = store.open_group(spark, f"{at}/group")
    rechunk(a, None, "8KB", into, strict_temp=False, array_name="label").execute()
    rechunk(a, (33,), "8KB", into, strict_temp=False, array_name="first/copy").execute()
    out = None
    for name, got in store.open_group(spark, f"{at}/group").arrays.items():
        s = got.df.select(F.lit(name).alias("array"), "k0", F.size("payload").cast("long").alias("cells"), F.aggregate("payload", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))
        out = s if out is None else out.unionByName(s)
    return out


@query("SELECT * FROM (VALUES ('array in group without name', 'ValueError'), ('array_name with group', 'ValueError'), ('existing target', 'ValueError'), ('no temporary store', 'ValueError'), ('source overwritten', 'ValueError'), ('unknown array', 'KeyError'), ('unknown dimension', 'KeyError'), ('unknown executor', 'ValueError'), ('unknown option', 'ValueError'), ('unknown source', 'ValueError')) t(misuse, error)")
def refused_calls(spark, sf_dir):
    """What ``rechunk`` refuses, and by which error."""
    at = files.scratch(spark, "refused")
    a = store.save_array(frames.generate(spark, ArrayMeta((8, 8), (2, 8), "f4", attrs={"_ARRAY_DIMENSIONS": ["x", "y"]})), f"{at}/source")
    store.create_group(spark, f"{at}/group")
    rechunk(a, (2, 8), 1000, f"{at}/there").execute()
    group = GroupFrame({"a": a})
    calls = {
        "array in group without name": lambda: rechunk(a, (8, 2), 1000, store.open_group(spark, f"{at}/group"), temp_store=f"{at}/temp"),
        "array_name with group": lambda: rechunk(group, {"a": (8, 2)}, 1000, f"{at}/new", array_name="a"),
        "existing target": lambda: rechunk(a, (2, 8), 1000, f"{at}/there"),
        "no temporary store": lambda: rechunk(a, (8, 2), 64, f"{at}/new"),
        "source overwritten": lambda: rechunk(a, (8, 2), 1000, f"{at}/source", {"overwrite": True}, temp_store=f"{at}/temp"),
        "unknown array": lambda: rechunk(group, {"b": (8, 2)}, 1000, f"{at}/new"),
        "unknown dimension": lambda: rechunk(a, {"x": 8, "z": 2}, 1000, f"{at}/new"),
        "unknown executor": lambda: rechunk(a, (2, 8), 1000, f"{at}/new", executor="nothing"),
        "unknown option": lambda: rechunk(a, (2, 8), 1000, f"{at}/new", {"colour": 1}),
        "unknown source": lambda: rechunk([1, 2], (1,), 1000, f"{at}/new", spark=spark),
    }
    found = []
    for name, call in calls.items():
        try:
            call()
            found.append((name, "none"))
        except Exception as e:
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "misuse string, error string")


@query("SELECT k AS \"key\", k * k AS square FROM range(20) t(k)")
def user_stages(spark, sf_dir):
    """Stages of a user's own over keys, one after the other: a stage reads what all keys of the one before wrote."""
    at = files.scratch(spark, "stages")

    def write(key, config):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(config)
        with where.open_output_stream(f"{root}/{key}.csv") as out:
            out.write(f"{key},{key * key}\n".encode())

    def check(config):
        if len(spark.read.text(config).inputFiles()) != 20:
            raise ValueError("a stage began before the one before it was done")

    files.write_text(spark, f"{at}/_made", "")
    run = pipelines.executor("spark")
    stages = [pipelines.Stage(write, "write", range(20)), pipelines.Stage(check, "check")]
    run.run_pipelines(run.pipelines_to_plan([pipelines.Pipeline(stages, at)]), spark)
    return spark.read.schema("key long, square long").csv(at)
