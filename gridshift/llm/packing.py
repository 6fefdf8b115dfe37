"""Hierarchical multi-length packing (operator 1).

Documents are routed by length to context-size tiers, each tier is packed, the gaps of the
longest windows are filled from shorter tiers, and the windows are dealt to step groups of
equal token budgets. All decisions rest on the histogram of piece lengths (one count for each
possible length, so at most ``window`` counts at any corpus size): the driver plans window
patterns over counts, and each piece finds its place by its rank among pieces of its length.
No task and not the driver ever sees the pieces of a tier together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import tokenizer, tokenizer_path

WINDOW = 4096
#: Context sizes; windows of a shorter tier are emitted only if exactly full, so they need no padding.
TIERS = (512, 1024, 2048)
END = 2
#: Pieces are cut from a document in blocks of at most this many rows per batch.
BATCH = 4096
#: Documents with an order are packed in spans of it, of about so many windows; at most so many spans, each planned alone.
SPAN, SPANS = 64, 64
#: Small corpora still have FEW spans, as long as one has so many windows.
FEW, LEAST = 16, 8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, window: int = WINDOW, path: str | None = None, order: str | None = None) -> DataFrame:
    """Pieces of whole texts: full windows, then the rest of each document as one piece; with the column ``order`` as ``place``.

    A null text is empty. Every document ends with one end id, so it has at least one token.
    """
    path = path or tokenizer_path()
    common.ship(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"]

    def pieces(batches):
        import pyarrow as pa

        tok = tokenizer(path)
        for b in batches:
            out = []
            for doc, ids, place in zip(b.column(0).to_pylist(), tok.many(b.column(1)), b.column(2).to_pylist(), strict=True):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    out.append((doc, at, len(part) // 4, zlib.crc32(part), n, place))
            for k in range(0, len(out), BATCH):
                cols = zip(*out[k : k + BATCH], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    place = F.col(f"`{order}`").cast("long") if order else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place).mapInArrow(pieces, PIECES + ", place long")


def tier_of(n: int, tiers: tuple[int, ...] = TIERS, window: int = WINDOW) -> int:
    """The context size that a piece of ``n`` tokens is routed to: the least that holds it."""
    return next((t for t in sorted(tiers) if n <= t), window)


def exact_fill(pool: np.ndarray, room: int, deep: int = 3) -> list[int] | None:
    """Lengths that ``pool`` (how many there are of each) still has and that add up to ``room`` exactly.

    One piece, else two, the longer one as long as can be; else the longest that fits and then the same for the rest.
    """
    if not room:
        return []
    if room < len(pool) and pool[room] > 0:
        return [room]
    there = pool[1 : min(room, len(pool))] > 0
    if len(there) == room - 1:
        pairs = np.flatnonzero(there & there[::-1]) + 1
        pairs = pairs[(2 * pairs > room) | (2 * pairs == room) & (pool[pairs] > 1)]
        if len(pairs):
            return [int(pairs[-1]), room - int(pairs[-1])]
    fits = np.flatnonzero(there)
    if not deep or not len(fits):
        return None
    n = int(fits[-1]) + 1
    pool[n] -= 1
    rest = exact_fill(pool, room - n, deep - 1)
    pool[n] += 1
    return None if rest is None else [n, *rest]


def plan(counts: dict[int, int], window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[int], int]]:
    """Window patterns ``(tier, piece lengths, how many such windows)`` that use up ``counts``.

    1. Each piece is routed to the least tier that holds it.
    2. Each shorter tier is packed into exactly full windows (others would be padded to ``window``): each piece, the longest
       first, with pieces of its own and shorter tiers that fill the rest to the token. Half of the pieces are kept back, to
       fill gaps of long windows; so is what finds no exact fill.
    3. The pieces of the longest tier, and what is left, go into windows of ``window`` tokens: the longest piece left opens a
       window, and the longest that still fits, from any tier, fills its gap (best fit decreasing).

    A pattern is repeated as long as its counts last. Patterns come tier by tier.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    patterns: list[tuple[int, list[int], int]] = []

    def use(tier, lengths, times):
        patterns.append((tier, lengths, times))
        for n in lengths:
            left[n] -= times

    for t in sorted(tiers):
        if left.get(t, 0):
            use(t, [t], left[t])  # as long as the tier: full alone
        routed = sorted((n for n, c in left.items() if c > 0 and tier_of(n, tiers, window) == t), reverse=True)
        pool = np.zeros(t + 1, "i8")
        for n, c in left.items():
            if n < t:
                pool[n] = c // 2
        for n in routed:
            while pool[n] > 0:
                pool[n] -= 1
                rest = exact_fill(pool, t - n)
                pool[n] += 1
                if rest is None:
                    break
                need = {m: [n, *rest].count(m) for m in (n, *rest)}
                times = min(int(pool[m]) // k for m, k in need.items())
                use(t, [n, *rest], times)
                for m, k in need.items():
                    pool[m] -= k * times
    if left.get(window, 0):
        use(window, [window], left[window])
    there = sorted(k for k, v in left.items() if v > 0)
    while there:
        lengths, room, need = [], window, {}
        while there:
            k = bisect_right(there, room) - 1
            while k >= 0 and need.get(there[k], 0) >= left[there[k]]:
                k -= 1
            if k < 0:
                break
            n = there[k]
            take = min(room // n, left[n] - need.get(n, 0))
            lengths += [n] * take
            need[n] = need.get(n, 0) + take
            room -= n * take
            if not room:
                break
        times = min(left[n] // m for n, m in need.items())
        use(window, lengths, times)
        for n in need:
            if not left[n]:
                there.remove(n)
    return patterns


def places(patterns: list[tuple[int, list[int], int]], window: int = WINDOW, group_windows: int = 64) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks with their first sequence, offset, tier and step groups.

    Windows of a tier are dealt in turn to that tier's step groups, so these have equal numbers of windows but for one. A
    step group holds the tokens of ``group_windows`` long windows, and as each pattern's windows are dealt to all
    groups, real tokens are balanced as well.
    """
    rows, used, sequence = [], {}, 0
    per_tier: dict[int, int] = {}
    for tier, _, times in patterns:
        per_tier[tier] = per_tier.get(tier, 0) + times
    groups, first = {}, 0
    for tier in sorted(per_tier):
        groups[tier] = (first, max(1, -(-per_tier[tier] * tier // (group_windows * window))))
        first += groups[tier][1]
    for tier, lengths, times in patterns:
        at = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, at, tier, *groups[tier]))
            used[n] = used.get(n, 0) + times
            at += n
        sequence += times
    rows.sort()
    cols = np.array(rows, "i8").reshape(-1, 7).T
    return {k: cols[i] for i, k in enumerate(("length", "lo", "sequence", "offset", "tier", "group", "groups"))} | {"key": (cols[0] << 44) | cols[1]}


PLACED = PIECES + ", sequence_id long, offset long, window long, step_group long"


def pack(docs: DataFrame, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, path: str | None = None, group_windows: int = 64, order: str | None = None, span: int = SPAN) -> DataFrame:
    """One row for each piece of every document, with its sequence, its offset there and its step group.

    Sequences hold at most ``window`` tokens; those of a shorter tier are exactly full
    (``window`` gives the context size). Null and empty texts are one end id. Repeated
    documents are packed as often as they occur (rows with the same doc_id too); very long ones are cut into full windows
    and a rest. Pieces of one length are alike, ties between them go by doc_id and start. An empty table gives no rows. Other columns of ``docs`` are ignored.

    ``order`` names a column of whole numbers from 0, without nulls, that tells documents' order. It is cut into spans of
    about ``span`` windows (at most SPANS; shorter ones in small corpora); each is packed by itself, sequences and step groups are numbered span
    after span, and within one, pieces of a length are used in order.
    """
    pieces = common.staged(cut(docs, window, path, order))
    ends, tokens = pieces.agg(F.max("place") + 1, F.sum("length")).first()
    windows = (tokens or 0) // window
    spans = max(1, min(SPANS, max(windows // span, min(FEW, windows // LEAST)), (1 << 19) // (window + 1))) if order else 1
    salts = max(16, common.partitions(docs.sparkSession))
    # a piece's kind: its span and its length
    pieces = pieces.withColumn("kind", F.floor(F.col("place") * spans / F.lit(ends)).cast("long") * (window + 1) + F.col("length"))
    kinds: list[dict[int, int]] = [{} for _ in range(spans)]
    for r in pieces.groupBy("kind").agg(F.count("*").alias("n")).collect():  # at most `spans` times `window` rows
        kinds[r["kind"] // (window + 1)][r["kind"] % (window + 1)] = r["n"]
    parts, sequences, steps = [], 0, 0
    for k, counts in enumerate(kinds):
        patterns = plan(counts, window, tiers)
        where = places(patterns, window, group_windows)
        where["key"] += k * (window + 1) << 44
        where["sequence"] += sequences
        where["turn"] = np.full(len(where["key"]), sequences)
        where["group"] += steps
        parts.append(where)
        sequences += sum(times for *_, times in patterns)
        steps = max(steps, int((where["group"] + where["groups"]).max(initial=0)))
    where = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        import pyarrow as pa

        for b in batches:
            kind, rank = (b.column(n).to_numpy() for n in ("kind", "rank"))
            k = np.searchsorted(where["key"], (kind << 44) | rank, side="right") - 1
            sequence = where["sequence"][k] + rank - where["lo"][k]
            group = where["group"][k] + (sequence - where["turn"][k]) % where["groups"][k]
            more = (sequence, where["offset"][k], where["tier"][k], group)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *map(pa.array, more)], names=[*names, "sequence_id", "offset", "window", "step_group"])

    # parts of one kind are stretches of its span, so ranks follow the order
    part = F.floor((F.col("place") * spans / F.lit(ends)) % 1 * salts).cast("int") if order else None
    return common.ranked(pieces, "kind", ["place", "doc_id", "start"] if order else ["doc_id", "start"], part=part).mapInArrow(place, PLACED)
