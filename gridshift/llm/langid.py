"""Language identification by cross-parsing entropy (operator 6).

Whole running texts are parsed into longest matches of each language's labelled sample, whose substrings a suffix
automaton holds. All texts of a batch are parsed side by side, one step of all of them being a few array operations.
"""

from __future__ import annotations

import unicodedata
from math import log2

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bounds of the labelled sample, for each language: documents, their characters (a longer document is only taken if there
#: are no others, and then gives a passage of this length), and characters after which no further document is added.
DOCS_PER_LANG, DOC_CHARS, ENOUGH_CHARS = 64, 20_000, 40_000
UNKNOWN = "und"
#: A language can be told if its share is this many times what each would have if nothing told them apart.
CLEAR = 1.2
#: The first step of drawing the sample deals each language's documents to so many parts.
_SALTS = 64
#: Languages whose automata share a table (they are walked together), and the low bits of its entries.
TOGETHER, _ENDS, _MASK = 4, 2, 3
_MODELS: dict = {}
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For each code point: 2 if it is a letter, 1 if it is a mark that belongs to one, 0 otherwise."""
    if not _KINDS:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000:
                table[c] = {"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0)
        _KINDS.append(table)
    return _KINDS[0]


def letters(text: str | None) -> bytes:
    """The lower-cased text's words in UTF-8, each run of what is neither letter nor mark as one space, with
    a space at both ends; nothing if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds()[points]
    if not (kind == 2).any():
        return b""
    out = np.concatenate(([32], np.where(kind > 0, points, 32), [32])).astype("<u4")
    gap = out == 32
    return out[np.concatenate(([True], ~(gap[1:] & gap[:-1])))].tobytes().decode("utf-32-le").encode()


class SuffixAutomaton:
    """All substrings of a sequence of numbers; a state's edges are kept in a dictionary."""

    def __init__(self, codes):
        self.edges: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        edges = self.edges
        for c in codes:
            cur = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = cur
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur


class CrossParser:
    """Phrase counts of texts for every language.

    The automata of TOGETHER languages are one table with a row for each state and a column for each byte that samples
    have. An entry is where the next row begins, and below that how many phrases end: none where an edge leads on; one where
    a match ends and the byte begins the next; and one more for a byte that the sample lacks.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        texts = [b" " + b"".join(letters(t)[1:] for t in samples[k]) for k in self.langs]
        used = sorted(set(b"".join(texts)))
        self.codes = np.zeros(256, np.uint8)
        self.codes[used] = np.arange(1, len(used) + 1)
        self.size = len(used) + 1
        self.bits = np.array([log2(max(2, len(t))) for t in texts])
        self.tables = [self._table(texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER)]

    def _table(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The table of some languages, and where their first rows begin."""
        parts, roots, first = [], [], 0
        for t in texts:
            edges = SuffixAutomaton(self.codes[np.frombuffer(t, np.uint8)].tolist()).edges
            sizes = [len(e) for e in edges]
            state = np.repeat(np.arange(len(edges)), sizes)
            code = np.fromiter((c for e in edges for c in e), "i8", sum(sizes))
            to = np.fromiter((x for e in edges for x in e.values()), "i8", sum(sizes))
            anew = np.zeros(self.size, "i8")  # the state after a byte that begins a phrase
            anew[code[state == 0]] = to[state == 0]
            ended = 1 + (anew == 0)
            table = np.tile(((first + anew) * self.size << _ENDS) | ended, (len(edges), 1))
            table[0] -= 1  # nothing ends where nothing was begun
            table[state, code] = (first + to) * self.size << _ENDS
            if table.max() > np.iinfo("i4").max:
                raise ValueError("the sample of a language is too large")
            parts.append(table.astype("i4"))
            roots.append(first * self.size)
            first += len(edges)
        return np.concatenate(parts).ravel(), np.array(roots, "i4")

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many longest matches, one after another, each text is parsed into, by language.

        A byte that a language's sample lacks is a phrase. All texts take a step together, the longest first in line;
        those that are at their end are left behind.
        """
        counts = np.zeros((len(self.langs), len(texts)), "i8")
        sizes = np.array([len(t) for t in texts], "i8")
        order = np.argsort(-sizes, kind="stable")
        flat = self.codes[np.frombuffer(b"".join(texts[k] for k in order), np.uint8)]
        sizes = sizes[order]
        begin = np.cumsum(sizes) - sizes
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), side="right")
        for k, (table, roots) in enumerate(self.tables):
            some = counts[k * TOGETHER : (k + 1) * TOGETHER]
            width, at = len(texts), begin.copy()
            state = np.repeat(roots[:, None], width, axis=1)
            total = np.zeros(state.shape, "i4")
            for n in live.tolist():
                if n < width:
                    some[:, order[n:width]] = total[:, n:] + (state[:, n:] != roots[:, None])
                    state, total, at, width = state[:, :n].copy(), total[:, :n].copy(), at[:n].copy(), n
                entry = table[state + flat[at]]
                total += entry & _MASK
                state = entry >> _ENDS
                at += 1
            some[:, order[:width]] = total + (state != roots[:, None])
        return counts

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language whose sample parses each text into the fewest normalised phrases, and its share."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        points = [letters(t) for t in texts]
        known = [k for k, p in enumerate(points) if len(p)]
        if not known or not self.langs:
            return out
        points = [points[k] for k in known]
        entropy = self.phrases(points) * self.bits[:, None] / np.array([len(p) for p in points])
        best = entropy.argmin(axis=0)
        share = 1 / np.exp2(entropy[best, np.arange(len(best))] - entropy).sum(axis=0)
        for k, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
            out[k] = (self.langs[b], s)
        return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Whole texts of a bounded number of labelled documents for each language, drawn by a hash of doc_id.

    Rows whose crc32(doc_id) mod 4 is 2, and rows without text, lang or doc_id, teach nothing; nor does a text without a
    letter. Of rows that share doc_id and lang one counts.
    """
    taught = docs.where("doc_id is not null and lang is not null and text rlike '\\\\p{L}'").where(~held_out())
    taught = taught.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rank = [F.length("text") > DOC_CHARS, F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = taught.select("doc_id", "lang", *(c.alias(f"rank_{k}") for k, c in enumerate(rank)), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_SALTS)).alias("salt"))
    for key in (["lang", "salt"], ["lang"]):  # no task ranks more than DOCS_PER_LANG rows of each salt in the end
        w = Window.partitionBy(*key).orderBy("rank_0", "rank_1", "rank_2")
        drawn = drawn.withColumn("k", F.dense_rank().over(w)).where(F.col("k") <= DOCS_PER_LANG).dropDuplicates(["lang", "doc_id", "salt"])
    chosen = F.broadcast(drawn.select("doc_id", "lang").distinct())  # DOCS_PER_LANG ids a language
    texts = taught.join(chosen, ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, DOC_CHARS)).alias("text"))
    out: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for r in sorted(texts.withColumn("rank", F.xxhash64("doc_id")).collect(), key=lambda r: (r["lang"], r["rank"], r["doc_id"])):
        if held.get(r["lang"], 0) < ENOUGH_CHARS:
            out.setdefault(r["lang"], []).append(r["text"])
            held[r["lang"]] = held.get(r["lang"], 0) + len(r["text"])
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone.

    The whole lower-cased text, with one space for each run of other characters than letters and their marks, is parsed into
    longest matches of each language's sample. Phrases times the bits of a pointer into the sample, over bytes of UTF-8, is the
    cross entropy; the least one wins, ties to the first lang in order. ``score`` is the winner's share of 2 to the power of
    minus entropy. A null text, a text without a letter, or no labelled text at all gives ``und`` and 0. Very long texts
    are parsed whole. Repeated rows stay; other columns are kept, lang among them but not looked at.
    """
    common.ship(docs.sparkSession)
    names = [f.name for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    d = docs.select(*(F.col(f"`{n}`") for n in names))
    at = names.index("text")

    def predict(batches):
        import pyarrow as pa

        key = hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = CrossParser(samples)
        for b in batches:
            said = _MODELS[key].predict(b.column(at).to_pylist())
            pred, score = zip(*said, strict=True) if said else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return d.mapInArrow(predict, T.StructType([*d.schema.fields, *new]))


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document. A null doc_id is not held out, and teaches nothing."""
    told = identify(docs.select("doc_id", "text"), sample(docs))
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows whose text is in a language that can be told, as they were.

    A text without a letter goes, and one whose best language is not ahead of the others: a score below
    CLEAR / languages (such as a word or two that several of them share). With one language, or without any labelled
    text, nothing is compared: then only texts without a letter go, or none. Columns named like the new ones keep their values.
    """
    samples = sample(docs)
    if not samples:
        return docs
    renamed, back = common.aside(docs, ["lang_pred", "score"])
    told = identify(renamed, samples)
    floor = min(1.0, CLEAR / len(samples))
    return back(told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= floor)))
