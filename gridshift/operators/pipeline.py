"""User-defined stages over lists of keys, copy specifications, and what carries them out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import SparkSession

from ..sources import store
from ..sources.frames import ArrayFrame
from .regrid import regrid


@dataclass(frozen=True)
class ArrayProxy:
    """An array seen through chunks; without an array, a grid that no store holds."""

    array: ArrayFrame | None
    chunks: tuple[int, ...] | None


@dataclass(frozen=True)
class CopySpec:
    """One array's copy: what is read, what goes between, what is written, and with which options."""

    read: ArrayProxy
    intermediate: ArrayProxy
    write: ArrayProxy
    options: dict = field(default_factory=dict)
    name: str | None = None


@dataclass(frozen=True)
class Stage:
    """``function(key, config=)`` for each key of ``mappable``; without keys, one call ``function(config=)``."""

    function: Callable[..., Any]
    name: str
    mappable: Iterable | None = None


@dataclass(frozen=True)
class Pipeline:
    stages: list[Stage]
    config: Any = None

    def __post_init__(self):
        # keys are kept, so that a plan can be carried out again
        object.__setattr__(self, "stages", [Stage(s.function, s.name, None if s.mappable is None else tuple(s.mappable)) for s in self.stages])


class Executor(Protocol):
    """What an executor must have to be given to ``rechunk``."""

    def prepare_plan(self, specs: list[CopySpec]) -> Any: ...

    def execute_plan(self, plan: Any, **kwargs) -> None: ...


class PipelineExecutor(Protocol):
    """What an executor of user-defined stages must have."""

    def pipelines_to_plan(self, pipelines: Iterable[Pipeline]) -> Any: ...

    def run_pipelines(self, plan: Any, spark: SparkSession | None = None) -> None: ...


def write(rows: ArrayFrame, spec: CopySpec, **kwargs) -> None:
    """The copy's rows into its target, in the target's format."""
    if spec.write.array.format == "zarr":
        from ..sources import zarr

        zarr.write_cells(rows, spec.write.array.path, spec.options)
    else:
        store.write_cells(rows, spec.write.array.path, spec.options, **kwargs)


def rows_of(spec: CopySpec) -> ArrayFrame:
    """The copy as lazy chunk rows."""
    target = spec.write.array.meta
    return regrid(spec.read.array, target.chunks, spec.write.chunks, dtype=target.dtype, order=target.order, fill=target.fill, attrs=target.attrs)


class SparkExecutor:
    """Copies are Spark jobs; those of one group run side by side. The plan is the lazy DataFrame of chunk rows, or one for each array."""

    #: Jobs submitted at a time.
    threads = 4

    def prepare_plan(self, specs: list[CopySpec]):
        made = [(spec, rows_of(spec)) for spec in specs]
        return Copies(made)

    def execute_plan(self, plan: Copies, **kwargs) -> None:
        def one(item):
            spec, rows = item
            write(rows, spec, **kwargs)

        with ThreadPoolExecutor(max(1, min(self.threads, len(plan.made)))) as pool:
            list(pool.map(one, plan.made))

    def pipelines_to_plan(self, pipelines: Iterable[Pipeline]) -> list[Pipeline]:
        return list(pipelines)

    def run_pipelines(self, plan: list[Pipeline], spark: SparkSession | None = None) -> None:
        """Stage after stage; a stage's keys are dealt to the executors, and its job's end is the barrier."""
        spark = spark or SparkSession.getActiveSession()
        for p in plan:
            for s in p.stages:
                run_stage(spark, s, p.config)


class TempStoreExecutor(SparkExecutor):
    """Copies through their temporary store, where there is one: the pieces are written there, and read for the target.

    Twice the bytes are written, but a copy that fails in its second half finds its pieces in the store.
    """

    def execute_plan(self, plan: Copies, **kwargs) -> None:
        made = []
        for spec, rows in plan.made:
            temp = spec.intermediate.array
            if temp is not None:
                target = spec.write.array.meta
                pieces = regrid(spec.read.array, temp.meta.chunks, dtype=target.dtype, fill=target.fill, order=temp.meta.order, attrs={})
                store.write_cells(pieces, temp.path)
                held = store.open_array(temp.df.sparkSession, temp.path)
                rows = regrid(ArrayFrame(pieces.meta, held.df), target.chunks, spec.write.chunks, dtype=target.dtype, order=target.order, fill=target.fill, attrs=target.attrs)
            made.append((spec, rows))
        super().execute_plan(Copies(made), **kwargs)


@dataclass
class Copies:
    made: list[tuple[CopySpec, ArrayFrame]]

    @property
    def frames(self) -> dict:
        return {spec.name: rows.df for spec, rows in self.made}

    def explain(self, *args) -> None:
        for _, rows in self.made:
            rows.df.explain(*args)


def run_stage(spark: SparkSession, stage: Stage, config: Any) -> None:
    if stage.mappable is None:
        stage.function(config=config)
        return
    from pyspark import cloudpickle

    keys = [(k, bytearray(cloudpickle.dumps(key))) for k, key in enumerate(stage.mappable)]
    if not keys:
        return
    function = stage.function

    def run(batches):
        import pandas as pd
        from pyspark import cloudpickle

        for b in batches:
            for key in b["key"]:
                function(cloudpickle.loads(bytes(key)), config=config)
            yield pd.DataFrame({"n": [len(b)]})

    d = spark.createDataFrame(keys, "id int, key binary")
    n = min(len(keys), 4 * spark.sparkContext.defaultParallelism)
    d.repartition(n, "id").mapInPandas(run, "n long").collect()  # one count a batch


class LocalExecutor:
    """Everything on the driver, with NumPy: to test and to debug."""

    def prepare_plan(self, specs: list[CopySpec]) -> list[CopySpec]:
        return specs

    def execute_plan(self, plan: list[CopySpec], **kwargs) -> None:
        for spec in plan:
            meta, source = spec.write.array.meta, spec.read.array
            cells = source.to_numpy().astype(meta.dtype)
            from ..functions.geometry import chunk_keys

            rows = [(*(s.start // c for s, c in zip(key, meta.chunks, strict=True)), cells[key].ravel(order=meta.order).tolist()) for key in chunk_keys(meta.shape, meta.chunks)]
            schema = ", ".join(f"k{a} long" for a in range(meta.ndim)) + f", payload array<{meta.spark_type}>"
            write(ArrayFrame(meta, source.df.sparkSession.createDataFrame(rows, schema)), spec, **kwargs)

    def pipelines_to_plan(self, pipelines: Iterable[Pipeline]) -> list[Pipeline]:
        return list(pipelines)

    def run_pipelines(self, plan: list[Pipeline], spark: SparkSession | None = None) -> None:
        for p in plan:
            for s in p.stages:
                if s.mappable is None:
                    s.function(config=p.config)
                else:
                    for key in s.mappable:
                        s.function(key, config=p.config)


EXECUTORS = {"spark": SparkExecutor, "spark-temp": TempStoreExecutor, "local": LocalExecutor, "python": LocalExecutor}


def executor(name: str) -> Executor:
    if name.lower() not in EXECUTORS:
        raise ValueError(f"unrecognized executor {name}")
    return EXECUTORS[name.lower()]()
