"""Shared parts of the training-data operators: staging, code shipping, distributed ranks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``. Only a local session (one machine, as in
    tests) may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gridshift-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridshift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_file_order(docs: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``columns`` of ``docs`` and each row's place in the files that it was read from: files by their number, rows as they lie there.

    Rows that come from no file are staged first. Places grow from 0; rows filtered out leave gaps.
    """

    def located(df):
        at = df.metadataColumn("_metadata")
        return df.select(*columns, at["file_name"].alias("__file"), at["row_index"].alias("__row"))

    try:
        d = located(docs)
    except AnalysisException:
        d = located(staged(docs.select(*columns)))
    number = lambda name: tuple(int(m) for m in re.findall(r"^part-(\d+)|-c(\d+)\.", name) for m in m if m)
    sizes = {r["__file"]: r["n"] for r in d.groupBy("__file").agg((F.max("__row") + 1).alias("n")).collect()}  # a row for each file
    starts, at = [], 0
    for name in sorted(sizes, key=lambda f: (number(f), f)):
        starts.append((name, at))
        at += sizes[name]
    first = docs.sparkSession.createDataFrame(starts, "__file string, __first long")
    return d.join(F.broadcast(first), "__file").select(*columns, (F.col("__first") + F.col("__row")).alias(out))


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors through Spark's file server, once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix="gridshift-code-"), "gridshift_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, new: list[str]):
    """``df`` with the columns that an operator would replace renamed, and a function that gives ``df``'s own columns back."""
    held = {c: f"__held_{k}_{c}" for k, c in enumerate(df.columns) if c.lower() in new}
    return df.withColumnsRenamed(held), lambda out: out.select(*(F.col(f"`{held.get(c, c)}`").alias(c) for c in df.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, key: str, order: list[str], out: str = "rank", salts: int | None = None, part: Column | None = None) -> DataFrame:
    """Number the rows of each ``key`` gaplessly from 0 without putting a key's rows into one task.

    Rows of a key are dealt to ``salts`` parts by a hash of ``order``; each part is numbered by
    ``order`` and starts where the parts before it end. A hot key is as even as any other.
    ``key`` must hold no null (the window and the join then share one exchange of ``df``).
    ``df`` is read twice, so stage what is costly. ``order`` should be unique within a key;
    exact ties are numbered in an arbitrary order. ``part`` deals rows by its number instead of a hash; if it
    grows with ``order``, numbers follow ``order`` over all parts.
    """
    salts = salts or max(16, partitions(df.sparkSession))
    d = df.withColumn("__rank_part", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int") if part is None else part)
    sizes = d.groupBy(key, "__rank_part").agg(F.count("*").alias("__rank_n"))
    before = Window.partitionBy(key).orderBy("__rank_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "__rank_part", F.coalesce(F.sum("__rank_n").over(before), F.lit(0)).alias("__rank_before"))
    d = d.withColumn("__rank_row", F.row_number().over(Window.partitionBy(key, "__rank_part").orderBy(*order)))
    d = d.join(sizes, [key, "__rank_part"], "left")
    return d.withColumn(out, (F.col("__rank_before") + F.col("__rank_row") - 1).cast("long")).drop("__rank_part", "__rank_before", "__rank_row")


def runs(batches, keys: list[str]):
    """From Arrow batches sorted by ``keys``: each run of equal keys, with its rows as one table."""
    import numpy as np
    import pyarrow as pa

    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in keys])
        ends = [*(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        at = 0
        for end in ends:
            key = tuple(cols[:, at].tolist())
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = key, []
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield now, pa.Table.from_batches(held)


def matrix(lists):
    """Lists of numbers as rows of one float64 matrix, the shorter ones filled up with zeros."""
    import numpy as np

    lists = lists.combine_chunks() if hasattr(lists, "combine_chunks") else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("f8")
    d = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d))
    out[np.arange(d) < sizes[:, None]] = flat
    return out
