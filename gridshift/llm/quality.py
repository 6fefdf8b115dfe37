"""Quality classifier by co-training (operator 3).

Two separate views of a document: its text content (which byte pairs it is made of, and counts of its words, lines and
marks) and its page record (source, language and stated length; nothing that is read from the text). Each has a
classifier of its own; over rounds each one labels the unlabelled documents that it is surest of for the other. At the
end both are calibrated on labelled rows that neither was trained on, and every document gets the
joint score. Models are fitted on bounded samples; scoring is one pass over all documents.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the samples that the models are fitted on, drawn by a hash of doc_id.
LABELLED, UNLABELLED = 6000, 4000
ROUNDS = 4
#: Share of the unlabelled sample that a view may label in one round, and how sure it must be.
SHARE, SURE = 0.05, 0.95
#: Ridges of the text view's byte pairs and counts, and of the page view.
TEXT_RIDGE, PAGE_RIDGE = (20.0, 1.0), 5.0
#: Documents whose joint probability of good quality is at least this are kept.
KEEP = 0.5
TEXT_DIMS = 512
_COUNTS = 14
#: Values of source and of language are hashed to so many columns each; lengths have a column for each doubling.
_HASHED, _LENGTHS = 64, 24
PAGE_DIMS = 2 * _HASHED + _LENGTHS + 2
_BLOCK = 1 << 20
NEW = ["text_score", "page_score", "score", "keep"]


def text_view(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs (a vector of length one), then counts of words, lines and marks."""
    raw = text.encode()
    pairs = np.zeros(TEXT_DIMS)
    b = np.frombuffer(raw, np.uint8)
    for k in range(0, len(b), _BLOCK):
        part = b[k : k + _BLOCK + 1].astype("i4")
        if len(part) > 1:
            pairs += np.bincount((part[:-1] * 131 + part[1:]) & (TEXT_DIMS - 1), minlength=TEXT_DIMS)
    words, lines = text.split(), text.split("\n")
    n, w = max(1, len(text)), max(1, len(words))
    kinds = np.bincount(b, minlength=256)
    upper, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    spaces, digits, high = int(kinds[32] + kinds[10]), int(kinds[48:58].sum()), int(kinds[128:].sum())
    marks, stops = max(0, len(raw) - upper - lower - spaces - digits - high), int(kinds[46] + kinds[44])
    different = len(set(words))
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    counts = (
        np.log1p(n), np.log1p(w), np.log1p(len(lines)), np.log1p(w / len(lines)), different / w, different / w**0.7, len(set(lines)) / len(lines),
        upper / max(1, upper + lower), marks / w, (marks - stops) / w, stops / w, digits / n, spaces / n, n / w + doubled / w,
    )
    return np.concatenate([np.sqrt(pairs / max(1.0, pairs.sum())), counts])


def page_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The page's record: hashed source and language, the stated length and which doubling of it; null values have columns too."""
    out = np.zeros(PAGE_DIMS)
    out[zlib.crc32(("" if lang is None else "=" + lang).encode()) % _HASHED] = 1
    out[_HASHED + zlib.crc32(("" if source is None else "=" + source).encode()) % _HASHED] = 1
    length = max(0, n_chars or 0)
    out[2 * _HASHED + min(_LENGTHS - 1, length.bit_length())] = 1
    out[-2:] = np.log1p(length), n_chars is None
    return out


def views(text, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
    return text_view(text or ""), page_view(lang, source, n_chars)


class Logistic:
    """Logistic regression on standardised columns, both classes weighing the same; Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1.0, steps: int = 12):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = self._design(x)
        each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        self.w = np.zeros(z.shape[1])
        keep = np.append(np.broadcast_to(ridge, x.shape[1]), 1e-6)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (each * (p - y)) + keep * self.w
            hess = (z * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
            step = np.linalg.solve(hess + np.diag(keep), grad)
            self.w -= step
            if np.abs(step).max() < 1e-4:
                break

    def _design(self, x):
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w


class Constant:
    """Where labels have but one class (or there are none): the same answer for all."""

    def __init__(self, good: bool):
        self.value = 4.0 if good else -4.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _balanced(y: np.ndarray) -> bool:
    return (y == 0).sum() >= 2 and (y == 1).sum() >= 2


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The straight line that turns a view's logits into those of what is seen."""
    c = Logistic(z[:, None], y, ridge=0.1)
    slope = float(c.w[0] / c.scale[0])
    return slope, float(c.w[1] - slope * c.mean[0])


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, free_text: np.ndarray, free_page: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Models of both views, and how their logits are calibrated and joined.

    Every third labelled row is set apart for calibration. In each round each view labels, for
    the other, its surest unlabelled rows of either class; how sure it is, the rows set apart tell (a view that
    says nothing about them labels nothing).
    """
    if not _balanced(y):
        same = Constant(len(y) == 0 or y.mean() >= 0.5)
        return {"views": [same, same], "fit": [(1.0, 0.0), (1.0, 0.0)], "share": (0.5, 0.5)}
    apart = np.arange(len(y)) % 3 == 2
    if not (_balanced(y[apart]) and _balanced(y[~apart])):
        apart[:] = False
    held = apart if apart.any() else ~apart
    data, free = [text[~apart], page[~apart]], [free_text, free_page]
    x, target = list(data), [y[~apart], y[~apart]]
    used = [np.zeros(len(free_text), bool), np.zeros(len(free_text), bool)]
    ridges = (np.repeat(TEXT_RIDGE, (text.shape[1] - _COUNTS, _COUNTS)), PAGE_RIDGE)
    for turn in range(rounds + 1):
        models = [Logistic(x[v], target[v], ridges[v]) for v in (0, 1)]
        fit = [_calibrated(m.logit((text, page)[v][held]), y[held]) for v, m in enumerate(models)]
        if turn == rounds or not len(free_text):
            break
        for v in (0, 1):
            other, p = 1 - v, _chance(fit[v][0] * models[v].logit(free[v]) + fit[v][1])
            for label, sure in ((1, p), (0, 1 - p)):
                at = np.argsort(-sure, kind="stable")
                at = at[(sure[at] >= SURE) & ~used[other][at]][: max(1, int(SHARE * len(p)))]
                used[other][at] = True
                x[other] = np.concatenate([x[other], free[other][at]])
                target[other] = np.concatenate([target[other], np.full(len(at), label)])
    loss = []
    for v, (m, (a, b)) in enumerate(zip(models, fit, strict=True)):
        p = _chance(a * m.logit((text, page)[v][held]) + b)
        loss.append(max(1e-3, float(-np.log(np.where(y[held] == 1, p, 1 - p) + 1e-9).mean())))
    share = np.array([1 / v for v in loss])
    return {"views": models, "fit": fit, "share": tuple((share / share.sum()).tolist())}


def _sampled(docs: DataFrame, ids: DataFrame) -> dict[int, tuple]:
    """Both views of the documents whose ids are given (a bounded number); of rows that share an id one counts."""

    def run(batches):
        import pyarrow as pa

        names, types = ("doc_id", "t", "p"), (pa.int64(), pa.binary(), pa.binary())
        for b in batches:
            rows = [(r["doc_id"], *(v.astype("f4").tobytes() for v in views(r["text"], r["lang"], r["source"], r["n_chars"]))) for r in b.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows = _inputs(docs).join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, t binary, p binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("t", "p")).alias("v")).collect()
    return {r["doc_id"]: (np.frombuffer(r["v"]["t"], "f4"), np.frombuffer(r["v"]["p"], "f4")) for r in rows}


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The models, from LABELLED labelled and UNLABELLED other documents at most.

    Labels without doc_id or quality, and of no document, count for nothing: they are left out before any is drawn. A
    document with several labels has the worst of them; of rows that share a doc_id one is learnt from.
    """
    common.ship(docs.sparkSession)
    by_hash = F.xxhash64("doc_id"), F.col("doc_id")
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    told = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    told = told.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(there, "doc_id", "left_semi")  # before any is drawn
    told = {r["doc_id"]: int(r["quality"] > 0) for r in told.orderBy(*by_hash).limit(LABELLED).collect()}
    free = [r["doc_id"] for r in there.distinct().orderBy(*by_hash).limit(UNLABELLED).collect()]
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted({*told, *free})], "doc_id long")
    seen = _sampled(docs, ids) if told or free else {}
    a, b = sorted(set(told) & set(seen)), sorted((set(free) & set(seen)) - set(told))
    stack = lambda at, v, n: np.array([seen[i][v] for i in at], "f8").reshape(-1, n)
    return co_train(stack(a, 0, TEXT_DIMS + _COUNTS), stack(a, 1, PAGE_DIMS), np.array([told[i] for i in a], "i8"), stack(b, 0, TEXT_DIMS + _COUNTS), stack(b, 1, PAGE_DIMS))


def score(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """``docs`` with ``text_score``, ``page_score``, the joint ``score`` (0 to 1) and ``keep``.

    Every row is scored by its whole text, however long; null and empty texts are empty ones, a null source, lang or
    n_chars is a value like another. Labels of one class
    only, or none, give all rows the same score (kept, if there are none). Repeated rows stay. Columns of ``docs`` that
    clash with the new ones are replaced.
    """
    model = fit(docs, labels)
    names = [c for c in docs.columns if c.lower() not in NEW]
    d = docs.select(*(F.col(f"`{c}`") for c in names))
    at = [names.index(c) for c in ("text", "lang", "source", "n_chars")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            made = [views(t.as_py(), lang, source, n) for t, lang, source, n in zip(b.column(at[0]), *(b.column(k).to_pylist() for k in at[1:]), strict=True)]
            logits = [np.clip(m.logit(np.array([x[v] for x in made])) * s + c, -30, 30) for v, (m, (s, c)) in enumerate(zip(model["views"], model["fit"], strict=True))]
            joint = model["share"][0] * logits[0] + model["share"][1] * logits[1]
            p = [1 / (1 + np.exp(-z)) for z in (*logits, joint)]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, p), pa.array(p[2] >= keep)], names=[*names, *NEW])

    from pyspark.sql import types as T

    double = T.DoubleType()
    fields = [*d.schema.fields, *(T.StructField(c, double) for c in NEW[:3]), T.StructField("keep", T.BooleanType())]
    return d.mapInArrow(run, T.StructType(fields))
