"""Near copies by the similarity of word shingles, found with SimHash fingerprints and BK-trees (pipeline stage of operator 2).

A text stands for the set of its different shingles, as 64-bit hashes. Its SimHash fingerprint is searched in shard
trees; two texts meet in a shard if they share a band of min-hashes. What the trees link is then compared exactly:
the texts of one linked group go to a unit of work (a large group is dealt to pairs of blocks), which passes on
a spanning forest of the links that hold. No step has a row for each pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import LINKS, Forest, forest

#: Words in a shingle, and the Jaccard similarity from which two texts are near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Min-hash bands and min-hashes a band: of pairs at the similarity of 0.8 all but 7 in a million share a band.
BANDS, PER_BAND = 30, 5
#: Bits in which the fingerprints of two near copies may differ: 10 on average at 0.8, and this is 4.5 deviations more.
REACH = 23
#: Fingerprints in a shard tree, and words in a block of a group: what one unit of work holds (two blocks).
SHARD, BLOCK_WORDS = 1024, 1 << 20
#: Texts of a unit that are compared before it is known which of them has the most copies.
TRIED = 16
_MINS = BANDS * PER_BAND
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]
_PRIME, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which close ones are far apart."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 2 * _MINS + 1, dtype="u8") * _PRIME).reshape(2, _MINS) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Runs between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(max(1, n), base, "u8")) * np.uint64(pow(base, -1, 1 << 64))


def shingle_set(words: list[bytes], n: int = SHINGLE, block: int = 1 << 15) -> np.ndarray:
    """Hashes of the different runs of ``n`` words, in order; fewer words are one run, no words none.

    A run's bytes are the digits of a number in base _BASE modulo 2^64, taken from running sums over the whole text.
    """
    if not words:
        return np.zeros(0, "u8")
    runs, n = max(1, len(words) - n + 1), min(n, len(words))
    out = []
    for k in range(0, runs, block):
        part = words[k : k + block + n - 1]
        digits = np.frombuffer(b" ".join(part), np.uint8)
        while len(_POWERS[0]) < len(digits) + 1:
            _POWERS[:] = [_powers(x, 2 * len(_POWERS[0])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        sums = np.zeros(len(digits) + 1, "u8")
        np.cumsum((digits + np.uint64(1)) * _POWERS[0][: len(digits)], out=sums[1:])
        ends = np.cumsum(np.fromiter(map(len, part), "i8", len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(part) - n + 1]
        ends = ends[n - 1 :]
        h = (sums[ends] - sums[starts]) * _POWERS[1][starts]
        out.append(_mixed(h ^ _mixed((ends - starts).astype("u8") * _PRIME)))
    h = np.sort(np.concatenate(out))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def simhash(hashes: np.ndarray) -> int:
    """64 bits, as a signed long: bit k is set if it is set in over half of the hashes."""
    counts = np.zeros(64, "i8")
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="i4")
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key a band, made of its min-hashes and its number."""
    least = np.full(_MINS, np.iinfo("u8").max, "u8")
    for k in range(0, len(hashes), 512):
        part = hashes[None, k : k + 512] * _SEEDS[0][:, None]
        part ^= part >> np.uint64(29)
        least = np.minimum(least, (part * _SEEDS[1][:, None]).min(axis=1, initial=np.iinfo("u8").max))
    key = np.arange(1, BANDS + 1, dtype="u8")
    for column in least.reshape(BANDS, PER_BAND).T:
        key = _mixed(key * _PRIME + column)
    return key


def similar_links(sets: list[np.ndarray], asks: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Indices of the pairs that connect all pairs at least ``similar``, a spanning forest.

    If ``asks`` has both values, only pairs of one that asks and one that doesn't are looked at. A
    text that has too large a share of its shingles for itself alone is like no other; for all others the shared shingles with every
    other text are counted at once. Texts already linked with the one that had the most copies among the first TRIED need no
    turn of their own: whatever is not linked with it has one, and looks at them.
    """
    sizes = np.array([len(s) for s in sets], "i8")
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if sets else np.zeros(0, "u8")
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, "i8")
    times = np.diff(np.append(first, len(flat)))
    several = np.repeat(times > 1, times)
    held = np.bincount(owner[several], minlength=len(sets))
    # each text's shingles that others have too, as ranges of `owner`
    at = np.repeat(first, times)[several]
    count = np.repeat(times, times)[several]
    by_text = np.argsort(owner[several], kind="stable")
    at, count = at[by_text], count[by_text]
    ends = np.cumsum(held)
    two, both, out = asks.any() and not asks.all(), Forest(), []
    turns = np.flatnonzero((held > 0) & (held >= similar * sizes))
    if two:
        turns = np.concatenate([turns[asks[turns]], turns[~asks[turns]]])
    most, hub, passed = -1, -1, False
    for turn, k in enumerate(turns.tolist()):
        if two and not asks[k] and not passed:
            break  # every text that asks had its turn
        if turn >= TRIED and both.root(k) == both.root(hub):
            passed = True
            continue
        a, n = at[ends[k] - held[k] : ends[k]], count[ends[k] - held[k] : ends[k]]
        before = np.cumsum(n) - n
        shared = np.bincount(owner[np.repeat(a - before, n) + np.arange(int(n.sum()))], minlength=len(sets))
        like = shared >= similar * (sizes + sizes[k] - shared)
        like[k] = False
        if two:
            like &= asks != asks[k]
        found = np.flatnonzero(like).tolist()
        if turn < TRIED and len(found) > most:
            most, hub = len(found), k
        out += [(k, j) for j in found if both.join(k, j)]
    return out


def _verified(texts: DataFrame, similar: float, shingle: int) -> DataFrame:
    """Links ``(u, v)`` that connect the near copies within each group of ``texts(comp, blocks, node, text)``."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    d = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    d = d.select("comp", *unit, (F.col("own") > F.col("other")).cast("int").alias("asks"), "node", "text")
    d = d.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def check(batches):
        import pyarrow as pa

        def linked(sets, asks, nodes):
            found = similar_links(sets, np.array(asks, bool), similar) if len(sets) > 1 else []
            ends = ([nodes[x] for x in side] for side in (zip(*found, strict=True) if found else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["u", "v"])

        now, sets, asks, nodes, seen = None, [], [], [], set()
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in ("comp", "i", "j")), strict=True))
            for key, ask, node, text in zip(keys, b.column("asks").to_pylist(), b.column("node").to_pylist(), b.column("text"), strict=True):
                if key != now:
                    if sets:
                        yield linked(sets, asks, nodes)
                    now, sets, asks, nodes, seen = key, [], [], [], set()
                if node not in seen:  # a document that is there twice counts once
                    seen.add(node)
                    sets.append(shingle_set(words_of(text.as_py()), shingle))
                    asks.append(ask)
                    nodes.append(node)
        if sets:
            yield linked(sets, asks, nodes)

    return d.mapInArrow(check, LINKS)


MARKED = "doc_id long, text_hash long, norm_1 long, norm_2 long, words long, fp long, bands array<long>"


def text_hash() -> F.Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def classes(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, shard: int = SHARD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text_hash, class_id, class_hash``: each text with the least (doc_id, text_hash) of its class.

    Classes are the connected components of texts with a Jaccard similarity of at least ``similar`` (of the sets of
    ``shingle``-word runs, exactly computed). Pairs get compared if a BK-tree search links them, directly or through others: their
    fingerprints are within REACH bits and they share one of BANDS bands. A pair at the similarity of 0.8 does, but for about
    one in a hundred thousand.

    Texts of the same words (A-Z and a-z, and white space, alike) are one from the start; null, empty and wordless ones
    are such a class. Rows without doc_id have no class (they are not in the result) and link nothing. Rows that share a
    doc_id but not the text are texts of their own. Very long texts count whole. Ties cannot matter: classes do not depend
    on any order. An empty table has no rows. Other columns are ignored.
    """
    common.ship(docs.sparkSession)

    def mark(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        names = [x.split()[0] for x in MARKED.split(", ")]
        for b in batches:
            rows = []
            for text in b.column(2):
                words = words_of(text.as_py())
                norm = np.frombuffer(xxh3_128_digest(b" ".join(words)), "<i8")
                hashes = shingle_set(words, shingle)
                rows.append((*norm.tolist(), len(words), simhash(hashes), bands(hashes).view("i8")))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            lists = pa.ListArray.from_arrays(np.arange(0, BANDS * len(rows) + 1, BANDS, dtype="i4"), np.concatenate([np.zeros(0, "i8"), *cols[4]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]), lists], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    own = own.where("doc_id is not null")
    marked = common.staged(own.mapInArrow(mark, MARKED))
    same = ["norm_1", "norm_2"]
    least = marked.groupBy(*same).agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), *(F.first(c).alias(c) for c in ("words", "fp", "bands")))
    nodes = common.staged(least.select(F.monotonically_increasing_id().alias("node"), "rep", *same, "words", "fp", "bands"))

    keyed = nodes.where("words > 0").select("fp", "node", F.explode("bands").alias("key"))
    groups = components(forest(keyed.select(F.lit(0).alias("c"), "key", "fp", "node"), REACH, shard))
    groups = nodes.join(groups.hint("merge"), "node").select("node", "rep.doc_id", "rep.text_hash", F.col("root").alias("comp"), "words")
    groups = common.staged(groups)
    sizes = groups.groupBy("comp").agg(F.ceil(F.sum("words") / block_words).cast("int").alias("blocks"))
    told = groups.join(sizes, "comp").select("node", "doc_id", "text_hash", "comp", "blocks")
    texts = own.join(told.hint("merge"), ["doc_id", "text_hash"]).select("comp", "blocks", "node", "text")
    roots = components(common.staged(_verified(texts, similar, shingle)))

    ends = nodes.join(roots.hint("merge"), "node", "left").select(*same, "rep", F.coalesce("root", "node").alias("root"))
    best = ends.groupBy("root").agg(F.min("rep").alias("best"))
    ends = ends.join(best.hint("merge"), "root").select(*same, F.col("best.doc_id").alias("class_id"), F.col("best.text_hash").alias("class_hash"))
    return marked.join(ends.hint("merge"), same).select("doc_id", "text_hash", "class_id", "class_hash")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, shard: int = SHARD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, component_id`` of every row with a doc_id: the smallest doc_id of its class (see :func:`classes`)."""
    found = classes(docs, shingle, similar, shard, block_words)
    return found.select("doc_id", F.col("class_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id; all columns as they were.

    Rows without doc_id have no class and stay. Of equal rows (same doc_id, same text) one stays; rows that share
    a doc_id but not the text are judged each by its own text.
    """
    mine = "__text_hash"
    found = common.staged(classes(docs).groupBy("doc_id", "text_hash").agg(F.min(F.struct("class_id", "class_hash")).alias("best"), F.count("*").alias("n")))
    stays = (F.col("best.class_id") == F.col("doc_id")) & (F.col("best.class_hash") == F.col("text_hash"))
    key = ["__doc_id", mine]
    renamed = lambda d: d.select(F.col("doc_id").alias(key[0]), F.col("text_hash").alias(mine))
    gone, again = renamed(found.where(~stays)), renamed(found.where(stays & (F.col("n") > 1)))
    rows = docs.withColumn(key[0], F.col("doc_id").cast("long")).withColumn(mine, text_hash())
    kept = rows.join(gone.hint("merge"), key, "left_anti")  # what goes grows with the corpus: no broadcast at any size
    if not again.isEmpty():
        once = kept.join(again.hint("merge"), key, "left_semi").dropDuplicates(key)
        kept = kept.join(again.hint("merge"), key, "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
