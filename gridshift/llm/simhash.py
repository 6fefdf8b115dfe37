"""SimHash near-duplicates found with BK-trees (operator 2)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH = 4
RADIUS = 4
#: Distinct fingerprints in one shard tree; a key that more share is dealt to several shards.
SHARD = 4096
#: The number of shared blocks is chosen so that a key has about this many fingerprints.
PER_KEY = 64
_BLOCK = 8192


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits: bit k is set if it is set in over half of the shingles' XXH64 values (seed 42).

    A-Z are lower-cased; words are runs between ASCII white space; shingles are ``width`` words,
    repeats included. Fewer words: the whole sequence is one shingle. No words: zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :]
    counts = np.zeros(64, "i8")
    for k in range(0, n, _BLOCK):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[k : k + _BLOCK].tolist(), ends[k : k + _BLOCK].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i4")
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


class BKTree:
    """Children hang on edges keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.names: list = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int, name) -> None:
        self.values.append(value)
        self.names.append(name)
        self.edges.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.edges[at].setdefault(d, new)
            if nxt == new:
                return
            at = nxt

    def near(self, value: int, radius: int):
        """Names of the values within ``radius``; only edges within it of the distance are followed."""
        if not self.values:
            return
        todo = [0]
        values, names, edges = self.values, self.names, self.edges
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield names[at]
            below = edges[at]
            if below:
                for k, child in below.items():
                    if -radius <= k - d <= radius:
                        todo.append(child)


def masks(shared: int, radius: int = RADIUS) -> list[int]:
    """Bit masks such that any two 64-bit values within ``radius`` agree under at least one of them.

    The bits are cut into ``radius + shared`` blocks; at most ``radius`` of them can differ.
    """
    cuts = [round(64 * k / (radius + shared)) for k in range(radius + shared + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LINKS = "u long, v long"


class Forest:
    """Union-find over the names met so far, and how many sets they are in."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.sets = 0

    def root(self, x: int) -> int:
        up = self.up
        if x not in up:
            up[x] = x
            self.sets += 1
            return x
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether ``x`` and ``y`` were apart until now."""
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[a] = b
        self.sets -= 1
        return True


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, per_key: int = PER_KEY) -> DataFrame:
    """Links between distinct fingerprints ``prints(fp, node)`` that suffice to connect what is within ``radius``.

    Exact at every size: fingerprints meet under the keys of :func:`masks`. The number of shared blocks follows from
    the count alone (with the radius of 4: 5, 15, 35 or 70 keys a fingerprint from 0, 262,144, 134 million and 8.6
    billion fingerprints on), so a key keeps about ``per_key`` of evenly spread fingerprints at any count.
    """
    n, shared = prints.count(), 1
    while shared < 4 and n > per_key << (64 * shared // (radius + shared)):
        shared += 1
    masked = enumerate(masks(shared, radius))
    keys = [F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in masked]
    keyed = prints.select("fp", "node", F.explode(F.array(*keys)).alias("at")).select("at.c", "at.key", "fp", "node")
    return forest(keyed, radius, shard)


def forest(keyed: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """Links ``(u, v)`` that connect what is within ``radius`` under one key of ``keyed(c, key, fp, node)``.

    Under a key, shards of at most about ``shard`` fingerprints become BK-trees; each pair of shards is one unit of
    work, so a hot key is dealt over many tasks. A unit passes on a spanning forest of the links that it finds, at
    most one link a fingerprint, never all pairs; once all that it met is one set, a search ends at its first hit.
    (Trees are built from the shuffled shards, in the tasks that search them: broadcasting them would take the
    fingerprints of all documents through the driver.)
    """
    common.ship(keyed.sparkSession)
    large = keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    large = large.select("c", "key", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    keyed = keyed.join(large, ["c", "key"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp", "node"), F.col("shards")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    unit = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    units = keyed.select("c", "key", *unit, (F.col("own") > F.col("other")).alias("asks"), "fp", "node")
    units = units.repartition("c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j", "asks")

    def search(batches):
        import pyarrow as pa

        found, now, tree, sets = [], None, BKTree(), Forest()
        for b in batches:
            for c, key, i, j, asks, fp, node in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if (c, key, i, j) != now:
                    now, tree, sets = (c, key, i, j), BKTree(), Forest()
                fp &= (1 << 64) - 1
                if asks or i == j:
                    sets.root(node)
                    for other in tree.near(fp, radius):
                        if sets.join(node, other):
                            found.append((node, other))
                        if sets.sets == 1:
                            break
                if not asks:
                    tree.add(fp, node)
                    sets.root(node)
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                found = []

    return units.mapInArrow(search, LINKS).distinct()


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` of whole texts; ``fp`` holds the 64 bits as a signed long."""
    common.ship(docs.sparkSession)

    def prints(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), "u8", b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("i8"))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(prints, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Each document's fingerprint and class: ``doc_id, fingerprint, component_id``.

    Equal texts meet as one fingerprint before any search. Null, empty and wordless texts have
    fingerprint zero and link like any other. A fingerprint that only rows without doc_id have
    takes no part in links; its component is null. Repeated rows stay. Other columns are ignored.
    """
    marked = common.staged(fingerprints(docs, width))
    prints = common.staged(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = components(links(prints, radius))
    classes = prints.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = marked.join(classes, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
