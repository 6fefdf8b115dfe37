"""Token ids of whole texts by a public tokenizer, with the ids of each word kept for the next time it is met."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    import pyarrow as pa

#: A worker keeps at most this many words that are not letters, and marks, with their ids; beyond that it starts anew.
KEPT_WORDS = 300_000
#: Characters of the texts whose words are merged in one call, about; a longer text is a run of its own.
RUN_CHARS = 2 << 20
#: ASCII marks that are cut off behind a word of letters; the apostrophe binds the letters after it.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The letters that a plain text can have.
ALPHABET = "".join(c for c in map(chr, range(0x180)) if c.isalpha())

#: Code points below U+0180 are their own canonical composition and lower-case alike in every library, but for U+0130. Those
#: from U+001C to U+001F, U+0085 and U+00A0 are not white space to everyone.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012f\u0131-\u017f]*")

_TOKENIZERS: dict = {}


def _plain(text: str) -> bool:
    """Whether ``text`` matches _PLAIN, by quicker means for most texts."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _PLAIN.fullmatch(text) is not None
    return "\x85" not in text and "\xa0" not in text


def gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of ``values``, one after the other: where each begins, and how long it is."""
    ends = np.cumsum(sizes)
    return values[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """The ids that ``tokenizers`` gives for whole texts, worked out by different words.

    For a tokenizer that drops white space and lower-cases, a text's ids are those of its
    white-space-separated words in turn, so a run of texts needs those of its different words only,
    and words of letters are looked at without the marks behind them. A text that
    holds ``<|`` (the beginning of the special tokens) or characters whose composition or
    case depends on their neighbours goes to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.one = self._merger(path)

    def library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merger(self, path: str):
        """A function from bare lower-case words to their ids: the same merges in the same order, run by tiktoken in one call.

        The end-of-word mark becomes a last byte of its own (0x01, which no word of letters has) that
        merges first. None (the library is then used) unless the merges are numbered in order.
        """
        import json

        import tiktoken

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, merges = model["vocab"], model["merges"]
        if model.get("end_of_word_suffix") != "</w>":
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(vocab.get(a + b) != 512 + k for k, (a, b) in enumerate(pairs)):
            return None
        ranks, back = {}, {}
        for token, i in vocab.items():
            end = token.endswith("</w>") and len(token) > 4
            raw = bytes(byte[c] for c in (token[:-4] if end else token)) + b"\x01" * end
            rank = i if i >= 512 else i - 256 if end else i + 256
            ranks[raw], back[rank] = rank, i
        ranks[b"\x01"] = len(vocab) + 1024
        core = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        table, last = np.zeros(len(vocab) + 1025, "<u4"), np.zeros(len(vocab) + 1025, bool)
        table[list(back)] = list(back.values())
        last[[rank for raw, rank in ranks.items() if raw.endswith(b"\x01")]] = True

        def merge(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            import pyarrow as pa
            import pyarrow.compute as pc

            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("\x01 ", pa.large_string()))[0].as_py()
            got = np.array(core.encode_ordinary(joined + "\x01"), "i8")
            return table[got], np.diff(np.flatnonzero(last[got]) + 1, prepend=0)

        return merge

    def _kept(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library, word by word, and how many each word has."""
        known, out = self.words, []
        for w in words:
            got = known.get(w)
            if got is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                got = known[w] = self.library(w)
            out.append(got)
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), "i8", len(out)) // 4

    def _different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different lower-case words, and how many each has. Words of letters, whatever marks are behind them, are merged in one call."""
        import pyarrow.compute as pc

        if self.one is None:
            return self._kept(words.to_pylist())
        cores = pc.ascii_rtrim(words, TAIL)
        plain = pc.utf8_is_alpha(cores)
        letters = plain.to_numpy(zero_copy_only=False)
        core = cores.filter(plain).dictionary_encode()
        marks = pc.utf8_ltrim(words.filter(plain), ALPHABET)
        mark = marks.dictionary_encode()
        pools = [self.one(core.dictionary) if len(core) else self._kept([]), self._kept(mark.dictionary.to_pylist()), self._kept(words.filter(pc.invert(plain)).to_pylist())]
        ids, base = np.concatenate([p[0] for p in pools]), np.cumsum([0, *(len(p[0]) for p in pools)])
        firsts = [np.cumsum(n) - n + at for (_, n), at in zip(pools, base, strict=False)]
        first, sizes = np.zeros((len(words), 2), "i8"), np.zeros((len(words), 2), "i8")
        for column, pool, rows, which in ((0, 0, letters, core.indices.to_numpy()), (1, 1, letters, mark.indices.to_numpy()), (0, 2, ~letters, slice(None))):
            first[rows, column], sizes[rows, column] = firsts[pool][which], pools[pool][1][which]
        return gathered(ids, first.ravel(), sizes.ravel()), sizes.sum(axis=1)

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return self._run([text])[0]

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """``ids`` of each text of an Arrow column; a null one is an empty text.

        Texts are taken in runs of about RUN_CHARS characters, so memory is bounded by that and the longest text.
        """
        run, held = [], 0
        for text in texts:
            text = text.as_py() or ""
            if run and held + len(text) > RUN_CHARS:
                yield from self._run(run)
                run, held = [], 0
            run.append(text)
            held += len(text)
        yield from self._run(run)

    def _run(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = {k: self.library(t) for k, t in enumerate(texts) if "<|" in t or not _plain(t)}
        # the white space of plain texts is that of ASCII
        lists = pc.ascii_split_whitespace(pa.array(["" if k in whole else t.lower() for k, t in enumerate(texts)], pa.large_string()))
        met = lists.flatten().dictionary_encode()
        ids, each = self._different(met.dictionary)
        words = met.indices.to_numpy()
        sizes = each[words]
        ids = gathered(ids, (np.cumsum(each) - each)[words], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()].tolist()
        return [whole[k] if k in whole else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


def tokenizer(path: str) -> WordTokenizer:
    """One a worker process; its words serve all tasks that the process runs."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]
