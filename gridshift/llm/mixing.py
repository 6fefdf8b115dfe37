"""Mixing sources to target weights with Pfair scheduling (operator 4).

Every block of a source has a release time and a deadline from its weight; earliest deadline first interleaves the sources.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents in a block, the unit that is scheduled.
BLOCK = 16
#: Blocks in the whole schedule, which the driver makes, at most: a block has as many more documents as that takes.
BLOCKS = 1 << 20
NEW = ["mix_block", "mix_position"]


def schedule(blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The slot of every block, source after source, each source's blocks in turn.

    The fluid mix serves every source at the rate of its weight among those that are not used up. Block j of a source
    is released in the slot in which the fluid mix begins it and due by the one in which it ends it; earliest deadline first
    among the released meets all deadlines, as the rates add up to one. So no source is ever a block from its fluid share.
    """
    blocks, weights = np.asarray(blocks, "i8"), np.asarray(weights, "f8")
    source = np.repeat(np.arange(len(blocks)), blocks)
    j = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    ends = blocks / weights  # the virtual time at which each source is used up; its service is weight times virtual time
    order = np.argsort(ends, kind="stable")
    gone = np.concatenate(([0.0], np.cumsum(blocks[order])))
    on = np.concatenate((np.cumsum(weights[order][::-1])[::-1], [0.0]))

    def served(v):
        k = np.searchsorted(ends[order], v, side="left")
        return gone[k] + v * on[k]

    release = np.floor(served(j / weights[source]) + 1e-7).astype("i8")
    due = np.ceil(served((j + 1) / weights[source]) - 1e-7).astype("i8")
    coming = np.lexsort((source, due, release))
    releases, dues, at = release[coming].tolist(), due[coming].tolist(), coming.tolist()
    slots, ready, k = np.zeros(len(at), "i8"), [], 0
    for t in range(len(at)):
        while k < len(at) and (releases[k] <= t or not ready):
            heapq.heappush(ready, (dues[k], at[k]))
            k += 1
        slots[heapq.heappop(ready)[1]] = t
    return slots


class Placer:
    """From a source and a document's rank there to its position in the mix, gapless from 0."""

    def __init__(self, counts: list[int], weights: list[float], block: int = BLOCK):
        self.block = block
        counts = np.array(counts, "i8")
        blocks = -(-counts // block)
        self.slots, self.first = schedule(blocks, weights), np.cumsum(blocks) - blocks
        held = np.flatnonzero(counts)
        last = self.slots[(self.first + blocks - 1)[held]]
        order = np.argsort(last)
        self.short_at = last[order]
        self.short_by = np.concatenate(([0], np.cumsum((-counts % block)[held][order]))).astype("i8")

    def positions(self, source: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = self.slots[self.first[source] + rank // self.block]
        return b * self.block + rank % self.block - self.short_by[np.searchsorted(self.short_at, b, side="left")], b


def positive(weights: list[float]) -> list[float]:
    """The weights, those that are none (zero, negative, not finite) as small as the smallest that is; all one if none is."""
    real = [w for w in weights if 0 < w < float("inf")]
    least = min(real, default=1.0)
    return [w if 0 < w < float("inf") else least for w in weights]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with ``mix_block`` and ``mix_position``: every row once, in an order that keeps to the target weights.

    ``weights`` gives each source's share; sources not in it get the smallest weight in it. By
    default a source weighs the square root of its rows. In every prefix of blocks each source is
    less than one block from its share, by the weights as they are; when one runs out of rows, the
    others share its slots, and nothing is dropped or repeated. The schedule is made on the driver, one number a block; so a block holds a ``blocks``-th of all documents, ``block`` at
    least, and the driver's work and what executors get does not grow with the documents. Weights of zero, below it or not
    finite count as the smallest there are: nothing is left out. A null source is the empty one. Every source has a schedule of its own, however many there are (the driver holds a row for each). Within a
    source, documents come in an order given by a hash of doc_id. Repeated rows stay, an
    empty table stays empty.
    """
    common.ship(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in NEW]
    d = docs.select(*(F.col(f"`{c}`") for c in names))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sizes = d.groupBy(source.alias("__mix_source")).agg(F.count("*").alias("n")).collect()
    sizes = sorted((r["__mix_source"], r["n"]) for r in sizes)
    total = sum(n for _, n in sizes)
    if not total:
        return d.withColumn("mix_block", F.lit(0).cast("long")).withColumn("mix_position", F.lit(0).cast("long"))
    counts = [n for _, n in sizes]
    if weights:
        least = min(positive(list(weights.values())))
        target = [weights.get(s, least) for s, _ in sizes]
    else:
        target = [n**0.5 for n in counts]
    block = max(block, -(-total // blocks))
    placer = Placer(counts, positive(target), block)
    number = {s: k for k, (s, _) in enumerate(sizes)}
    d = d.withColumn("__mix_class", source)
    d = common.ranked(d.withColumn("__mix_hash", F.xxhash64("doc_id")), "__mix_class", ["__mix_hash", "doc_id"], "__mix_rank").drop("__mix_hash")
    at = d.columns.index("__mix_class"), d.columns.index("__mix_rank")

    def place(batches):
        import pyarrow as pa

        for b in batches:
            names_in = b.column(at[0]).dictionary_encode()
            classes = np.array([number[s] for s in names_in.dictionary.to_pylist()], "i8")[names_in.indices.to_numpy()]
            position, blk = placer.positions(classes, b.column(at[1]).to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(blk), pa.array(position)], names=[*names, *NEW])

    from pyspark.sql import types as T

    fields = [d.schema[n] for n in names] + [T.StructField("mix_block", T.LongType()), T.StructField("mix_position", T.LongType())]
    return d.select(*(F.col(f"`{c}`") for c in d.columns)).mapInArrow(place, T.StructType(fields))
