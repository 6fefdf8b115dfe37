"""Approximate nearest neighbours along shifted space-filling curves (operator 5)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CURVES = 4
#: Projected dimensions and bits a dimension; their product is at most 62.
DIMS, BITS = 8, 7
#: Each curve turns the AXES directions of most variance its own way; they are those of a sample of so many vectors.
AXES, SAMPLE = 16, 4096
#: Rows of one key range of a curve (a stretch, the unit of work), and of one of its buckets, in which windows are counted.
STRETCH, BUCKET = 8192, 32
#: Queries that meet a stretch in one unit of work, about; queries that are scored against their common window at a time.
QUERY_BLOCK, TOGETHER = 4096, 32
#: The windows' width is measured on this many queries, and is the least that finds this share of their true neighbours.
CALIBRATION, RECALL = 128, 0.96
_SLACK = 1e-9


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, dims), each coordinate below 2**bits.

    Works bit plane by bit plane on all points at once, undoing the curve's exchanges and
    inversions (Skilling, "Programming the Hilbert curve", 2004), then interleaves the bits.
    """
    x = cells.astype("i8").T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def axes_of(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of unit vectors, and their directions of most variance, each as a column."""
    mean = sample.mean(axis=0)
    _, turned = np.linalg.eigh((sample - mean).T @ (sample - mean))
    return mean, turned[:, ::-1][:, :AXES]


def curve_keys(vectors: np.ndarray, curve: int, mean: np.ndarray, axes: np.ndarray, spread: float) -> np.ndarray:
    """Hilbert keys of unit vectors on one curve: the main axes turned at random, shifted by part of the grid.

    Six times ``spread`` to either side fill half of the grid, and the shift is up to the other half.
    """
    rng = np.random.default_rng(1_000 + curve)
    turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], min(DIMS, axes.shape[1]))))
    at = (vectors - mean) @ (axes @ turn) / (12 * spread) + 0.25 + rng.random(turn.shape[1]) * 0.5
    return hilbert(np.clip(np.floor(at * 2**BITS), 0, 2**BITS - 1), BITS)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def first_of(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of sorted (score, id) pairs, where one differs from the pair before it."""
    return np.concatenate(([True], (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])))[: len(ids)]


def nearest(queries: np.ndarray, qids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, beyond: np.ndarray | None = None):
    """Each query's k nearest of a block of rows, as (query, row, score) rows; ties to smaller ids.

    ``beyond`` (queries x rows) marks the pairs outside of the query's window.

    Rows repeated under one id with one score count once. A matrix product picks all rows that may be among the k; those few are scored again one by one,
    so that a pair's score is the same wherever it is met.
    """
    out = []
    if not len(rows):
        return out
    near = _units(queries) @ _units(rows).T
    near[qids[:, None] == ids[None, :]] = -np.inf
    if beyond is not None:
        near[beyond] = -np.inf
    norms = np.sqrt((rows * rows).sum(axis=1))
    for i in range(len(queries)):
        line = near[i]
        q, take = queries[i], k
        while True:
            least = np.partition(line, -take)[-take] if len(line) > take else -np.inf
            at = np.flatnonzero(line >= max(least - _SLACK, -2.0))
            score = (rows[at] * q).sum(axis=1) / (norms[at] * math.sqrt((q * q).sum()))
            best = np.lexsort((ids[at], -score))
            best = best[first_of(score[best], ids[at][best])][:k]
            if len(best) == k or len(line) <= take:
                break
            take *= 4  # rows repeated under one vec_id took places
        out += zip([int(qids[i])] * len(best), ids[at][best].tolist(), score[best].tolist(), strict=True)
    return out


FOUND = "query_id long, vec_id long, score double"


def _batch(rows):
    import pyarrow as pa

    q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = v.where(~bad)
    return v.where(F.exists("embedding", lambda x: x != 0)) if nonzero else v


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(q, qids, qb, rows, ids, rb, width: int, k: int):
    """Each query's k nearest among the rows whose bucket is within ``width`` of its own; a batch for some queries at a time."""
    order, mine = np.argsort(rb, kind="stable"), np.argsort(qb, kind="stable")
    rows, ids, rb, q, qids, qb = rows[order], ids[order], rb[order], q[mine], qids[mine], qb[mine]
    for i in range(0, len(q), TOGETHER):
        some = slice(i, i + TOGETHER)
        a = np.searchsorted(rb, qb[some][0] - width, side="left")
        b = np.searchsorted(rb, qb[some][-1] + width, side="right")
        beyond = np.abs(qb[some][:, None] - rb[None, a:b]) > width
        yield nearest(q[some], qids[some], rows[a:b], ids[a:b], k, beyond)


def search(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = CURVES, stretch: int = STRETCH, bucket: int = BUCKET) -> DataFrame:
    """The k nearest found, by cosine, of each row whose vec_id is divisible by ``every``.

    All rows are ordered along several Hilbert curves, each over a turned and shifted grid of the directions of most variance,
    and range-partitioned into stretches of neighbouring keys, cut into buckets. A query meets the buckets within
    ``width`` of its own on each curve (stretches that its window reaches into are merged), and what the curves find is merged and
    ranked again by the exact cosine. ``width`` is measured: the true neighbours of at most
    CALIBRATION queries (found by scanning all rows) tell the least width that reaches RECALL.
    On data without structure that is most of the curve; it is never capped.

    Rows with a null vec_id or a null, zero or non-finite vector take no part; shorter vectors count as
    filled up with zeros. Rows that share the query's vec_id are not its candidates; rows repeated under
    one vec_id with one score count once. Ties go to the smaller vec_id. Fewer candidates than k: all of them. No rows: none.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    v = usable(vectors, nonzero=True)
    n, dims = v.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    drawn = _units(np.array([[*r["embedding"], *[0.0] * (dims - len(r["embedding"]))] for r in drawn]))
    mean, axes = axes_of(drawn)
    spread = max(float(((drawn - mean) @ axes).std()), 1e-6)

    def keys(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            m = common.matrix(b.column(1))
            m = _units(np.pad(m, ((0, 0), (0, dims - m.shape[1]))))
            for c in range(curves):
                key = pa.array(curve_keys(m, c, mean, axes, spread))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c, "i4")), key, *b.columns], names=["curve", "key", "vec_id", "embedding"])

    keyed = common.staged(v.mapInArrow(keys, "curve int, key long, vec_id long, embedding array<double>"))
    stretches, cuts = max(1, -(-n // stretch)), max(1, stretch // bucket)

    def cut(batches):
        """One stretch, all rows of this partition, in order of its keys and cut into equal buckets."""
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        order = np.lexsort((t.column("vec_id").to_numpy(), t.column("key").to_numpy()))
        first = int(t.column("stretch")[0].as_py()) * cuts
        buckets = np.empty(len(order), "i8")
        buckets[order] = first + np.arange(len(order)) * cuts // len(order)
        t = t.select(["curve", "stretch", "vec_id", "embedding"]).add_column(2, "bucket", pa.array(buckets))
        yield from t.to_batches(max_chunksize=4096)

    at = None
    for c in range(curves):
        part = keyed.where(F.col("curve") == c).repartitionByRange(stretches, "key", "vec_id").withColumn("stretch", F.spark_partition_id())
        part = part.mapInArrow(cut, "curve int, stretch int, bucket long, vec_id long, embedding array<double>")
        at = part if at is None else at.unionByName(part)
    at = common.staged(at)
    width = window_width(at, every, k)

    asked = at.where(F.col("vec_id") % every == 0)
    meets = n / every * min(1.0, (2 * width + cuts) / (cuts * stretches))
    blocks = max(1, math.ceil(meets / QUERY_BLOCK))
    names = ["curve", "stretch", "block", "asks", "bucket", "vec_id", "embedding"]
    rows = at.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(0))
    ends = f"cast(greatest(0, bucket - {width}) div {cuts} as int)", f"cast(least({cuts * stretches - 1}, bucket + {width}) div {cuts} as int)"
    asked = asked.withColumn("stretch", F.explode(F.sequence(*map(F.expr, ends)))).withColumn("asks", F.lit(1))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    units = rows.select(names).unionByName(asked.select(names)).repartition("curve", "stretch", "block").sortWithinPartitions("curve", "stretch", "block", "asks")

    def score(batches):
        for _, t in common.runs(batches, ["curve", "stretch", "block"]):
            asks = t.column("asks").to_numpy() == 1
            ids, buckets, m = t.column("vec_id").to_numpy(), t.column("bucket").to_numpy(), common.matrix(t.column("embedding"))
            for found in _scored(m[asks], ids[asks], buckets[asks], m[~asks], ids[~asks], buckets[~asks], width, k):
                yield _batch(found)

    return _ranked(units.mapInArrow(score, FOUND), k)


def window_width(at: DataFrame, every: int, k: int) -> int:
    """The least number of buckets to either side with which the calibration queries find RECALL of their true neighbours."""
    drawn = at.where((F.col("curve") == 0) & (F.col("vec_id") % every == 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).select("vec_id", "embedding").collect()
    if not drawn:
        return 0
    qids = np.array([r["vec_id"] for r in drawn], "i8")
    size = max(len(r["embedding"]) for r in drawn)
    queries = np.array([[*r["embedding"], *[0.0] * (size - len(r["embedding"]))] for r in drawn])

    def scan(batches):
        for b in batches:
            if b.num_rows:
                rows = common.matrix(b.column(1))
                d = max(rows.shape[1], queries.shape[1])
                pad = lambda m: np.pad(m, ((0, 0), (0, d - m.shape[1])))
                yield _batch(nearest(pad(queries), qids, pad(rows), b.column(0).to_numpy(), k))

    true = _ranked(at.where(F.col("curve") == 0).select("vec_id", "embedding").mapInArrow(scan, FOUND), k).select("query_id", "vec_id")  # CALIBRATION x k rows
    own = at.where(F.col("vec_id").isin(qids.tolist())).select("curve", F.col("vec_id").alias("query_id"), F.col("bucket").alias("own")).distinct()
    far = at.select("curve", "vec_id", "bucket").join(F.broadcast(true), "vec_id").join(F.broadcast(own), ["curve", "query_id"])
    far = far.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("bucket") - F.col("own"))).alias("far"))
    steps = np.sort(np.array([r["far"] for r in far.collect()], "i8"))
    return int(steps[min(len(steps) - 1, math.ceil(RECALL * len(steps)) - 1)]) if len(steps) else 0
