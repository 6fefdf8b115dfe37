"""An array that grows along its first axis while rows stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import ArrayMeta
from ..sources.frames import from_cells


def append_cells(stream: DataFrame, path: str, meta: ArrayMeta, checkpoint: str, trigger: dict | None = None):
    """Write a stream of cells ``i0 .., v`` as chunk rows, one folder a micro-batch (so that a repeated batch replaces its own).

    A chunk whose cells come in several batches has a row in each; :func:`read_appended` puts them together, the
    latest batch winning a cell. ``meta.shape[0]`` is an upper bound of the first axis.
    """

    def batch(cells: DataFrame, epoch: int) -> None:
        keys = [F.expr(f"i{a} div {c}L").alias(f"k{a}") for a, c in enumerate(meta.chunks)]
        names = [f"i{a}" for a in range(meta.ndim)]
        rows = cells.select(*keys, F.struct(*names, "v").alias("cell")).groupBy(*(f"k{a}" for a in range(meta.ndim))).agg(F.collect_list("cell").alias("cells"))
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_appended(spark, path: str, meta: ArrayMeta):
    """The array as it stands."""
    names = [f"i{a}" for a in range(meta.ndim)]
    cells = spark.read.parquet(path).select("epoch", F.explode("cells").alias("cell")).select("epoch", "cell.*")
    latest = cells.groupBy(*names).agg(F.max_by("v", "epoch").alias("v"))
    return from_cells(latest, meta)
