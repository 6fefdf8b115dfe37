"""Packed token-id matrices (operator 8): best-fit decreasing with a segment tree over capacities."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .packing import END, WINDOW
from .tokens import tokenizer, tokenizer_path

#: Tokens that are packed at a time; bounds a task's memory.
BLOCK_TOKENS = 2_000_000
PAD = 0


class Capacities:
    """A segment tree over remaining capacities: how many open rows have each; finds the least that is enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        self.open.setdefault(room, []).append(row)
        k = room + self.size
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open row with the least room of at least ``need``, and that room; it is removed."""
        tree, k = self.tree, need + self.size
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.size
        row = self.open[room].pop()
        while k:
            tree[k] -= 1
            k >>= 1
        return row, room


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Rows of piece indices: longest first, each into the fullest row that still has room for it."""
    rows: list[list[int]] = []
    free = Capacities(window)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        got = free.take(lengths[k])
        row, room = got or (len(rows), window)
        if got is None:
            rows.append([])
        rows[row].append(k)
        if room > lengths[k]:
            free.put(room - lengths[k], row)
    return rows


MATRIX = "row_id long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"


def packed(docs: DataFrame, window: int = WINDOW, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One record for each row of the packed id matrix.

    ``ids`` holds ``window`` little-endian 32-bit ids (the end padded with 0), ``cu_seqlens`` the
    cumulative segment lengths from 0, ``position_ids`` ``window`` little-endian 16-bit positions that
    start anew at each segment, ``doc_ids`` and ``starts`` where each segment comes from.
    Documents end with one end id; one longer than ``window`` is split into full rows and a rest,
    so its segments put in order of ``starts`` give it back. Rows are packed block by block within a task: no shuffle, and
    memory is bounded by ``block_tokens`` and the longest text. Null and empty texts are one end id.
    """
    path = path or tokenizer_path()
    common.ship(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def rows(pieces, first):
        import pyarrow as pa

        out = []
        for k, row in enumerate(best_fit([len(p[2]) // 4 for p in pieces], window)):
            ids = b"".join(pieces[i][2] for i in row)
            lengths = [len(pieces[i][2]) // 4 for i in row]
            used = len(ids) // 4
            at = np.zeros(window, "<u2")
            at[:used] = np.concatenate([np.arange(n) for n in lengths])
            out.append((first + k, ids + np.full(window - used, PAD, "<u4").tobytes(), np.cumsum([0, *lengths]).tolist(), at.tobytes(), [pieces[i][0] for i in row], [pieces[i][1] for i in row]))
        types = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for k in range(0, len(out), 256):
            cols = zip(*out[k : k + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in MATRIX.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        tok, pieces, held = tokenizer(path), [], 0
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), tok.many(b.column(1)), strict=True):
                ids += end
                for at in range(0, len(ids) // 4, window):
                    pieces.append((doc, at, ids[4 * at : 4 * (at + window)]))
                held += len(ids) // 4
                if held >= block_tokens:
                    for out in rows(pieces, row):
                        row += out.num_rows
                        yield out
                    pieces, held = [], 0
        if pieces:
            yield from rows(pieces, row)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MATRIX)


def write(docs: DataFrame, path: str, **options) -> None:
    """The packed matrix as Parquet files, one record a row."""
    packed(docs, **options).write.parquet(path)


def digests(matrix: DataFrame) -> DataFrame:
    """One row a segment: where it is from, where it is, and the CRC-32 of its ids.

    A segment keeps its document's null doc_id; equal documents have segments of their own; the end id of a null or empty text is
    a segment of length one; a long text has as many segments as rows. No rows for an empty matrix. Other columns are ignored.
    """
    common.ship(matrix.sparkSession)

    def told(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for row, ids, cu, docs, starts in zip(*(b.column(n).to_pylist() for n in ("row_id", "ids", "cu_seqlens", "doc_ids", "starts")), strict=True):
                for k, (doc, start) in enumerate(zip(docs, starts, strict=True)):
                    out.append((row, k, doc, start, cu[k], cu[k + 1] - cu[k], zlib.crc32(ids[4 * cu[k] : 4 * cu[k + 1]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return matrix.mapInArrow(told, DIGEST)


DIGEST = "row_id long, segment long, doc_id long, start long, offset long, length long, ids_crc32 long"
