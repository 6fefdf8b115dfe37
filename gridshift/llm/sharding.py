"""Minimax contiguous partition into shards (operator 7)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LOW = -(1 << 63)
#: Bits by which ranges of the order key are refined at a time; at most 2^STEP children a range.
STEP = 10


def cuts(totals: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Greedy cuts: each shard takes groups in order while they fit. Cut k is the index where shard k + 1 begins."""
    before = np.concatenate(([0], np.cumsum(totals)))
    out, at = [], 0
    for _ in range(shards - 1):
        at = max(at, int(np.searchsorted(before, before[at] + capacity, side="right")) - 1)
        out.append(at)
    return out


def capacity(totals: np.ndarray, shards: int) -> int:
    """The smallest capacity with which :func:`cuts` leaves no shard above it (binary search)."""
    if not len(totals):
        return 0
    all_bytes = int(totals.sum())
    lo, hi = max(int(totals.max()), -(-all_bytes // shards)), all_bytes
    before = np.concatenate(([0], np.cumsum(totals)))
    while lo < hi:
        mid = (lo + hi) // 2
        last = cuts(totals, shards, mid)[-1] if shards > 1 else 0
        lo, hi = (lo, mid) if all_bytes - int(before[last]) <= mid else (mid + 1, hi)
    return lo


def boundaries(groups: DataFrame, shards: int) -> list[int]:
    """Order keys at which shards 1, 2, ... begin, from ``groups(h, bytes)``.

    The order keys' range is refined only where a cut can fall. Ranges are taken whole (an upper
    bound of the best capacity) or as if they could be cut anywhere but in the largest group (a lower bound); the
    greedy cuts of both enclose those of every capacity between. Ranges of more than one group
    that such a cut can touch are split by the next bits, until none is left: then cutting
    between the ranges is as good as cutting between the groups. The driver holds ranges, never groups.
    """
    place = F.col("h").bitwiseXOR(F.lit(_LOW))

    def split(within: list[int] | None, bits: int):
        prefix = F.shiftrightunsigned(place, 64 - bits)
        g = groups if within is None else groups.where(F.shiftrightunsigned(place, 64 - bits + STEP).isin(within))
        rows = g.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("most")).collect()
        return sorted((r["p"] << (64 - bits), r["bytes"], r["n"], bits, r["most"]) for r in rows)

    ranges = split(None, STEP)
    while ranges:
        totals = np.array([r[1] for r in ranges], "i8")
        before = np.concatenate(([0], np.cumsum(totals)))
        all_bytes = int(before[-1])
        least = max(-(-all_bytes // shards), max(r[4] for r in ranges))  # a shard holds the largest group
        most = capacity(totals, shards)
        touched, early, late = set(), 0, 0
        for _ in range(shards - 1):
            early = int(before[max(0, int(np.searchsorted(before, early + least, side="right")) - 1)])
            late = min(all_bytes, late + most)
            a = int(np.searchsorted(before, early, side="right")) - 1
            b = int(np.searchsorted(before, late, side="right")) - 1
            touched.update(k for k in range(a, min(b, len(ranges) - 1) + 1) if ranges[k][2] > 1 and ranges[k][3] + STEP <= 64)
        if not touched:
            break
        bits = min(ranges[k][3] for k in touched)
        now = [k for k in touched if ranges[k][3] == bits]
        finer = split([ranges[k][0] >> (64 - bits) for k in now], bits + STEP)
        drop = set(now)
        ranges = sorted([r for k, r in enumerate(ranges) if k not in drop] + finer)
    if not ranges:
        return []
    totals = np.array([r[1] for r in ranges], "i8")
    starts = [r[0] for r in ranges] + [1 << 64]
    return [starts[k] for k in cuts(totals, shards, capacity(totals, shards))]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Every document with its shard and its slot there; the largest shard's bytes are as few as can be.

    Size is the text's UTF-8 bytes plus 1. Equal texts are one atomic group and stay together
    (null and empty texts are equal; different texts with one XXH64 value would be too). Groups
    are ordered by that hash and cut into contiguous runs: the capacity is the smallest that
    works for this order. A group larger than a fair share makes its shard as large as it is.
    Fewer groups than shards: the last shards are empty. Repeated rows have slots of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    d = common.staged(d)
    groups = common.staged(d.groupBy("h").agg(F.sum("size").alias("bytes")))
    begin = boundaries(groups, shards)
    own = F.lit(0)
    for b in begin:
        if b < 1 << 64:
            own = own + (F.col("h") >= F.lit(b + _LOW)).cast("int")
    d = d.withColumn("shard", own.cast("int"))
    d = common.ranked(d, "shard", ["h", "doc_id"], "slot")
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
