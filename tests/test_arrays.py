import numpy as np
import pytest

from gridshift import rechunk
from gridshift.functions.geometry import chunk_keys, dim_chunks_to_targets, keys_frame
from gridshift.meta import DIMENSION_KEY, ArrayMeta
from gridshift.operators import regrid as R
from gridshift.operators.pipeline import LocalExecutor, Pipeline, SparkExecutor, Stage, executor
from gridshift.sources import frames, store, zarr
from gridshift.sources.frames import ArrayFrame, DatasetFrame, GroupFrame


def coded(spark, shape, chunks, dtype="f8", **more):
    return frames.generate(spark, ArrayMeta(shape, chunks, dtype, **more))


def numbers(shape, dtype="f8"):
    return np.arange(np.prod(shape)).reshape(shape).astype(dtype)


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}"


@pytest.mark.parametrize("shape,chunks,to", [((7, 5), (3, 2), (2, 5)), ((10,), (3,), (7,)), ((5, 6, 4), (2, 6, 1), (5, 1, 4)), ((8, 8), (4, 4), (2, 2)), ((3, 3, 2, 2), (1, 3, 2, 1), (3, 2, 1, 2))])
@pytest.mark.parametrize("order", ["C", "F"])
def test_regrid_keeps_every_cell(spark, shape, chunks, to, order):
    a = coded(spark, shape, chunks)
    assert (a.to_numpy() == numbers(shape)).all()
    b = R.regrid(a, to, order=order)
    assert (b.to_numpy() == numbers(shape)).all()
    assert (R.regrid(b, chunks, order="C").to_numpy() == numbers(shape)).all()
    assert (R.by_cells(a, a.meta.with_(chunks=to, order=order)).to_numpy() == numbers(shape)).all()


def test_exchanges(spark):
    plan = lambda a: a.df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    a = coded(spark, (12, 12), (6, 12))
    assert plan(R.regrid(a, (6, 12))) == 0 and plan(R.regrid(a, (3, 4))) == 0 and plan(R.regrid(a, (12, 2))) == 1


def test_slices_reach_the_scan(spark, at):
    a = store.save_array(coded(spark, (100, 20), (10, 5)), f"{at}/a")
    part = a.read(slice(30, 45), slice(4, 6))
    assert "PushedFilters: [IsNotNull(k0)" in part._jdf.queryExecution().executedPlan().toString()
    got = {(r.i0, r.i1): r.v for r in part.collect()}
    want = numbers((100, 20))
    assert got == {(i, j): want[i, j] for i in range(30, 45) for j in range(4, 6)}


def test_grid_keys(spark):
    rows = [tuple(r) for r in keys_frame(spark, (500, 64), (60, 7)).select("start0", "stop0", "start1", "stop1").collect()]
    keys = [(a.start, a.stop, b.start, b.stop) for a, b in chunk_keys((500, 64), (60, 7))]
    assert len(keys) == 90 and sorted(rows) == sorted(keys)


def test_chunks_by_dimension():
    v = {"aaa": (("lon", "lat", "time"), (360, 180, 365), None), "lazy": (("lon",), (360,), (90,))}
    assert dim_chunks_to_targets(v, {"lat": 10_000, "time": -1}) == {"aaa": (360, 180, 365), "lazy": (90,)}
    assert dim_chunks_to_targets(v, {"lon": 10}) == {"aaa": (10, 180, 365), "lazy": (10,)}


@pytest.mark.parametrize("name", ["spark", "Local"])
def test_rechunk_array(spark, at, name):
    a = store.save_array(coded(spark, (40, 30), (10, 30), "f4", attrs={"foo": "bar", DIMENSION_KEY: ["y", "x"]}), f"{at}/s")
    r = rechunk(a, {"y": 40, "x": 5}, "2.4KB", f"{at}/t", temp_store=f"{at}/tmp", executor=name)
    assert store.open_array(spark, f"{at}/t").attrs["foo"] == "bar"  # there before it is carried out
    assert store.open_array(spark, f"{at}/tmp").meta.chunks == (20, 15)
    assert all(w in repr(r) for w in ("Source", "Intermediate", "Target")) and "Intermediate" in r._repr_html_()
    for _ in range(2):
        t = r.execute()
        assert t.meta.chunks == (40, 5) and (t.to_numpy() == numbers((40, 30), "f4")).all()
    with pytest.raises(ValueError, match="path .* contains an array"):
        rechunk(a, (40, 5), "2.4KB", f"{at}/t", temp_store=f"{at}/tmp2")
    t = rechunk(a, (40, 5), "2.4KB", f"{at}/t", {"overwrite": True}, strict_temp=False).execute()
    assert (t.to_numpy() == numbers((40, 30), "f4")).all()


def test_errors(spark, at):
    a = store.save_array(coded(spark, (40, 30), (10, 30)), f"{at}/s")
    g = GroupFrame({"a": a}, path=f"{at}/g")
    with pytest.raises(ValueError, match="A temporary store location must be provided"):
        rechunk(a, (40, 5), 4800, f"{at}/1")
    with pytest.raises(ValueError, match="unrecognized executor"):
        rechunk(a, (40, 5), 4800, f"{at}/2", executor="unknown")
    for o in ("shape", "chunks", "dtype", "store", "name", "unknown"):
        with pytest.raises(ValueError, match="Zarr options must not include"):
            rechunk(a, (10, 30), 4800, f"{at}/3", {o: 1})
    with pytest.raises(ValueError, match="Source must be"):
        rechunk([1], (1,), 10, f"{at}/4")
    with pytest.raises(ValueError, match="as a dict"):
        rechunk(g, (40, 5), 4800, f"{at}/5")
    with pytest.raises(ValueError, match="Can't specify `array_name`"):
        rechunk(g, {"a": (40, 5)}, 4800, f"{at}/6", array_name="x")
    with pytest.raises(ValueError, match="without a name for the array"):
        rechunk(a, (10, 30), 4800, g)
    with pytest.raises(ValueError):
        rechunk(a, {"y": 40, "x": 5}, 4800, f"{at}/7")
    with pytest.raises(ValueError, match="Chunks must be provided in 'target_chunks'"):
        rechunk(DatasetFrame({"a": coded(spark, (4,), (2,), attrs={DIMENSION_KEY: ["x"]})}), {"a": (4,)}, 4800, f"{at}/8", {"a": {"chunks": (1,)}})


def test_nested_group(spark, at):
    g = GroupFrame({"a": coded(spark, (5, 10, 20), (1, 10, 20), "f4"), "foo/bar/b": coded(spark, (20,), (10,), "f4"), "left": coded(spark, (4,), (2,))}, {"": {"description": "root"}, "foo": {"n": np.int64(1)}, "foo/bar": {"d": [1, 2]}, "bare": {"x": 1}})
    g = store.save_group(g, f"{at}/s")
    r = rechunk(g, {"a": (5, 10, 4), "foo/bar/b": (20,)}, 1600, f"{at}/t", temp_store=f"{at}/tmp", target_options={"a": {"compressor": "zstd"}})
    assert store.open_group(spark, f"{at}/t").group_attrs["foo"] == {"n": 1}
    t = r.execute()
    assert sorted(t) == ["a", "foo/bar/b"] and t.group_attrs["bare"] == {"x": 1} and t.attrs == {"description": "root"}
    assert (t["a"].to_numpy() == numbers((5, 10, 20), "f4")).all() and t["a"].meta.chunks == (5, 10, 4)
    assert (t["foo/bar/b"].to_numpy() == numbers((20,), "f4")).all()


def test_dataset_packing(spark, at):
    values = numbers((10, 6), "f8") / 10
    values[-1] = np.nan
    cells = spark.createDataFrame([(i, j, float(values[i, j])) for i in range(10) for j in range(6)], "i0 long, i1 long, v double")
    a = frames.from_cells(cells, ArrayMeta((10, 6), (5, 6), "f8", float("nan"), attrs={DIMENSION_KEY: ["x", "y"], "a2": [1, 2]}))
    cx = coded(spark, (10,), (5,), attrs={DIMENSION_KEY: ["x"]})
    d = DatasetFrame({"a": a, "cx": cx}, {"": {"foo": "bar"}}, coords=("cx",))
    r = rechunk(d, {"x": 2, "y": -1}, 480, f"{at}/t", {"a": {"dtype": "i4", "scale_factor": 0.1, "_FillValue": -9999, "compressor": "zstd"}}, strict_temp=False)
    t = r.execute()
    raw = store.open_array(spark, f"{at}/t/a")
    assert raw.meta.dtype == "<i4" and raw.meta.chunks == (2, 6) and raw.to_numpy()[-1].tolist() == [-9999] * 6
    assert np.allclose(t["a"].to_numpy(), values, equal_nan=True) and t.coords == ("cx",) and t.attrs["foo"] == "bar" and t["a"].attrs["a2"] == [1, 2]
    assert t["cx"].meta.chunks == (2,)


def test_fill_compression_and_passthrough(spark, at):
    a = frames.from_cells(spark.createDataFrame([(3, 1.0)], "i0 long, v double"), ArrayMeta((10,), (2,), "f8"))
    s = store.save_array(a, f"{at}/a", {"write_empty_chunks": False})
    assert s.df.count() == 1 and s.complete().count() == 5 and s.to_numpy().tolist() == [0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    ones = frames.generate(spark, ArrayMeta((400, 400), (100, 400), "f8"))
    from gridshift.sources import files

    store.save_array(ones, f"{at}/plain", {"compressor": None})
    store.save_array(ones, f"{at}/zstd", {"compressor": "zstd"})
    assert files.size(spark, f"{at}/zstd/data") < files.size(spark, f"{at}/plain/data")
    t = rechunk(ones, None, 10**7, f"{at}/through").execute()
    assert t.meta.chunks == (100, 400) and (t.to_numpy() == numbers((400, 400))).all()


def test_array_into_group(spark, at):
    store.create_group(spark, f"{at}/g")
    t = rechunk(coded(spark, (6,), (2,)), (3,), 100, store.open_group(spark, f"{at}/g"), array_name="b", strict_temp=False).execute()
    assert t.to_numpy().tolist() == list(range(6)) and "b" in store.open_group(spark, f"{at}/g").arrays


def test_stages_in_turn(spark):
    a = coded(spark, (30, 30), (30, 1))
    assert (R.regrid_in_stages(a, (1, 30), 40, 240).to_numpy() == numbers((30, 30))).all()


def test_unaligned_and_empty_cells(spark):
    a = frames.from_cells(spark.createDataFrame([], "i0 long, v double"), ArrayMeta((4,), (2,), "f8", 7.0))
    assert R.regrid(a, (3,)).to_numpy().tolist() == [7.0] * 4
    with pytest.raises(ValueError):
        ArrayMeta((4,), (2,), "O")


@pytest.mark.parametrize("level", [None, 3])
def test_zarr_files(spark, tmp_path, level):
    a = coded(spark, (7, 5), (3, 2), "f4", attrs={"foo": "bar"})
    at = f"file://{tmp_path}/z"
    zarr.write_array(a, at, level)
    b = zarr.open_array(spark, at)
    assert b.attrs == {"foo": "bar"} and (b.to_numpy() == numbers((7, 5), "f4")).all()
    (tmp_path / "z/0.1").unlink()
    assert (zarr.open_group(spark, f"file://{tmp_path}")["z"].to_numpy()[:3, 2:4] == 0).all()


@pytest.mark.parametrize("run", [SparkExecutor(), LocalExecutor()])
def test_pipelines(spark, tmp_path, run):
    import os

    def first(*, config):
        assert not os.path.exists(f"{config}/a")
        open(f"{config}/first", "a").close()

    def second(key, *, config):
        assert os.path.exists(f"{config}/first")
        open(f"{config}/{key}", "a").close()

    plan = run.pipelines_to_plan([Pipeline([Stage(first, "first"), Stage(second, "second", iter(["a", "b", 3]))], str(tmp_path))])
    run.run_pipelines(plan, spark)
    assert sorted(os.listdir(tmp_path)) == ["3", "a", "b", "first"]
    for k in ("a", "b", "3"):
        os.unlink(tmp_path / k)
    run.run_pipelines(plan, spark)  # a plan can be carried out again
    assert sorted(os.listdir(tmp_path)) == ["3", "a", "b", "first"]
    with pytest.raises(ValueError, match="unrecognized executor"):
        executor("none")


def test_streamed_cells(spark, tmp_path):
    from gridshift.streaming.append import append_cells, read_appended

    spark.createDataFrame([(i, float(i)) for i in range(10)], "i0 long, v double").write.parquet(f"{tmp_path}/in")
    meta = ArrayMeta((10,), (4,), "f8")
    append_cells(spark.readStream.schema("i0 long, v double").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", meta, f"{tmp_path}/cp").awaitTermination()
    assert read_appended(spark, f"{tmp_path}/out", meta).to_numpy().tolist() == list(range(10))


@pytest.mark.parametrize("dtype", ["u1", "u2", "u4", "i1", "f2", "b1", ">i4", "f8"])
def test_zarr_types(spark, at, dtype):
    want = (numbers((5, 4)) % 2 if dtype == "b1" else numbers((5, 4)) * (12 if dtype in ("u1", "f2") else 1)).astype(np.dtype(dtype))
    cells = spark.createDataFrame([(i, j, float(want[i, j])) for i in range(5) for j in range(4)], "i0 long, i1 long, v double")
    meta = ArrayMeta((5, 4), (2, 3), dtype)
    zarr.write_array(frames.from_cells(cells, meta), f"{at}/z", compressor="zstd")
    back = zarr.open_array(spark, f"{at}/z")
    assert back.meta.dtype == np.dtype(dtype).str and (back.to_numpy() == want).all()
    assert (R.regrid(back, (5, 1)).to_numpy() == want).all()


@pytest.mark.parametrize("compressor", [{"id": "blosc", "cname": c, "shuffle": s} for c in ("lz4", "zstd", "snappy") for s in (0, 1)] + [{"id": "gzip", "level": 2}, {"id": "bz2"}])
def test_zarr_compressors(spark, at, compressor):
    a = coded(spark, (60, 50), (30, 20), "f4")
    zarr.write_array(a, f"{at}/z", compressor=compressor)
    assert (zarr.open_array(spark, f"{at}/z").to_numpy() == numbers((60, 50), "f4")).all()


def test_blosc_containers_of_other_writers():
    """Several blocks, a stream for each byte of an item, a last block that is cut off, streams that are stored plainly."""
    import struct

    import pyarrow as pa

    raw = numbers((2500,), "f4").tobytes()
    size, block, lz4 = 4, 4096, pa.Codec("lz4_raw")
    blocks = [raw[k : k + block] for k in range(0, len(raw), block)]
    bodies = []
    for b in blocks:
        turned = np.frombuffer(b, np.uint8).reshape(-1, size).T.tobytes()
        streams = size if len(b) == block else 1
        parts = [turned[k * len(b) // streams : (k + 1) * len(b) // streams] for k in range(streams)]
        packed = [lz4.compress(p).to_pybytes() for p in parts]
        bodies.append(b"".join(struct.pack("<i", min(len(p), len(q))) + (q if len(q) < len(p) else p) for p, q in zip(parts, packed, strict=True)))
    starts = np.cumsum([zarr.HEADER + 4 * len(blocks), *map(len, bodies)])
    head = struct.pack("<BBBBIII", 2, 1, (1 << 5) | zarr.SHUFFLED, size, len(raw), block, int(starts[-1]))
    assert zarr.unblosc(head + struct.pack(f"<{len(blocks)}I", *starts[:-1].tolist()) + b"".join(bodies)) == raw
    noise = np.random.default_rng(0).bytes(999)
    assert zarr.unblosc(zarr.blosc(noise, 1)) == noise and zarr.unblosc(zarr.blosc(b"", 4)) == b""


def test_zarr_filters(spark, at):
    a = coded(spark, (40,), (15,), "i4")
    zarr.write_array(a, f"{at}/delta", filters=[{"id": "delta", "dtype": "<i4", "astype": "<i2"}])
    assert (zarr.open_array(spark, f"{at}/delta").to_numpy() == numbers((40,), "i4")).all()
    b = coded(spark, (40,), (15,), "f8")
    zarr.write_array(b, f"{at}/scaled", filters=[{"id": "fixedscaleoffset", "scale": 10, "offset": 5, "dtype": "<f8", "astype": "<i4"}])
    assert (zarr.open_array(spark, f"{at}/scaled").to_numpy() == numbers((40,), "f8")).all()
    with pytest.raises(ValueError, match="filter 'unknown'"):
        zarr.write_array(a, f"{at}/x", filters=[{"id": "unknown"}])


@pytest.mark.parametrize("name", ["spark", "spark-temp", "local"])
def test_zarr_targets(spark, at, name):
    g = GroupFrame({"a": coded(spark, (12, 10), (3, 10), "f4", attrs={"u": "m"}), "deep/b": coded(spark, (20,), (10,), "i2")}, {"": {"t": 1}, "deep": {"n": [1, 2]}})
    r = rechunk(g, {"a": (12, 2), "deep/b": (7,)}, 240, f"{at}/t", {"a": {"compressor": {"id": "blosc"}}}, f"{at}/tmp", {}, executor=name, target_format="zarr")
    t = r.execute()
    assert (t["a"].to_numpy() == numbers((12, 10), "f4")).all() and t["a"].meta.chunks == (12, 2) and t["a"].attrs == {"u": "m"}
    assert (t["deep/b"].to_numpy() == numbers((20,), "i2")).all() and t.group_attrs == {"": {"t": 1}, "deep": {"n": [1, 2]}}
    from gridshift.sources import files

    assert "deep/b/.zarray" in files.read_text(spark, f"{at}/t/.zmetadata")
    if name == "spark-temp":
        held = store.open_array(spark, f"{at}/tmp/a")
        assert (held.to_numpy() == numbers((12, 10), "f4")).all()  # the pieces are there
    with pytest.raises(ValueError, match="contains an array"):
        rechunk(g["a"], (12, 2), 240, f"{at}/t/a", strict_temp=False, target_format="zarr")
    with pytest.raises(ValueError, match="target_format"):
        rechunk(g["a"], (12, 2), 240, f"{at}/u", strict_temp=False, target_format="hdf5")


def test_dataset_to_zarr(spark, at):
    d = DatasetFrame({"v": coded(spark, (6, 4), (2, 4), attrs={DIMENSION_KEY: ["x", "y"]}), "x": coded(spark, (6,), (3,), attrs={DIMENSION_KEY: ["x"]})}, coords=("x",))
    t = rechunk(d, {"x": 6, "y": 2}, 1000, f"{at}/t", {"v": {"dtype": "i2", "scale_factor": 0.5}}, strict_temp=False, target_format="zarr").execute()
    assert zarr.open_array(spark, f"{at}/t/v").meta.dtype == "<i2" and np.allclose(t["v"].to_numpy(), numbers((6, 4))) and t.coords == ("x",)


@pytest.mark.parametrize("where", ["s", "s/deeper", ""])
def test_no_target_where_the_source_is(spark, at, where):
    a = store.save_array(coded(spark, (8, 8), (8, 2)), f"{at}/s")
    with pytest.raises(ValueError, match="where the source is"):
        rechunk(a, (2, 8), 1000, f"{at}/{where}".rstrip("/"), {"overwrite": True}, strict_temp=False)
    with pytest.raises(ValueError, match="where the source is"):
        rechunk(a, (2, 8), 1000, f"{at}/t", temp_store=f"{at}/s")
    assert (store.open_array(spark, f"{at}/s").to_numpy() == numbers((8, 8))).all()


def test_repeated_cells_are_refused(spark):
    for places in ([0, 0, 1, 3], [0, 1, 2, 3, 3], [1, 1]):
        a = frames.from_cells(spark.createDataFrame([(i, 10.0 + k) for k, i in enumerate(places)], "i0 long, v double"), ArrayMeta((4,), (4,), "f8"))
        with pytest.raises(Exception, match="more than once"):
            a.df.collect()


def test_plans_and_executors_of_ones_own(spark, at):
    """``plan`` is lazy chunk rows; an executor object of the caller's is used as it is."""
    a = coded(spark, (6, 6), (6, 1))
    r = rechunk(a, (1, 6), 1000, f"{at}/t", strict_temp=False)
    assert r.plan.count() == 6 and set(r.plan.columns) == {"k0", "k1", "payload"}
    seen = []

    class Own(SparkExecutor):
        def prepare_plan(self, specs):
            seen.append([s.write.chunks for s in specs])
            return super().prepare_plan(specs)

        def execute_plan(self, plan, **kwargs):
            seen.append(sorted(kwargs))
            super().execute_plan(plan, **kwargs)

    t = rechunk(a, (1, 6), 1000, f"{at}/own", strict_temp=False, executor=Own()).execute(maxRecordsPerFile=2)
    assert len(seen) == 2 and seen[1] == ["maxRecordsPerFile"] and (t.to_numpy() == numbers((6, 6))).all()


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from gridshift.sources import files

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.scratch(Cluster, "x")
    assert files.scratch(spark, "x") != files.scratch(spark, "x")


def test_tables_with_gaps(spark):
    """Missing rows, null values and short lists hold the fill value; repeated rows are refused."""
    lists = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (2, [4.0, None]), (3, None), (6, [5.0, 6.0, 7.0])], "id long, v array<double>")
    a = frames.from_lists(lists, "id", "v", ArrayMeta((7, 3), (2, 2), "f4", -1.0))
    want = np.full((7, 3), -1.0)
    want[0], want[2, 0], want[6] = [1, 2, 3], 4, [5, 6, 7]
    assert (a.to_numpy() == want).all() and (frames.from_lists(lists, "id", "v", ArrayMeta((7, 3), (4, 3), "f4", -1.0, "F")).to_numpy() == want).all()
    rows = spark.createDataFrame([(4, 1.5, 2), (0, None, 3), (1, 2.5, None)], "row long, x double, y int")
    d = frames.from_table(rows, "row", {"x": "f8", "y": "i4"}, 5, 2)
    assert d["x"].to_numpy().tolist() == [0, 2.5, 0, 0, 1.5] and d["y"].to_numpy().tolist() == [3, 0, 0, 0, 2]
    for make in (lambda: frames.from_lists(lists.union(lists), "id", "v", a.meta), lambda: frames.from_table(rows.union(rows), "row", {"x": "f8"}, 5, 2)["x"]):
        with pytest.raises(Exception, match="more than once"):
            make().df.collect()
