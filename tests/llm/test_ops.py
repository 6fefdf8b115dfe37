"""Each operator against a plain version of itself, and the odd cases that its docstring names."""

import functools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridshift.llm import ann, binary, common, html, langid, mixing, nearcopies, packing, quality, queries, sharding, simhash, tokens, topk
from gridshift.llm.components import components
from gridshift.llm.tokens import tokenizer, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _part int, rank int, shard int, length long"
TEXTS = ["", None, "the quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy dog", "x", "  \n\t ", "ünï cödé — “x” 日本 ﬁ Σ", "a,b;c. don't <|endoftext|> I'm", "word " * 30_000, "́combining é \x1c odd space", "1234 %%% ###"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, ("en", None, "fr")[k % 3], (None, "s0", "s1")[k % 3], None if k % 2 else len(t or ""), 0.5, 1, 2, 3, 4) for k, t in enumerate(TEXTS)]
    rows += [rows[2], rows[2], (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, packing.END]


def test_tokens_are_the_librarys():
    tok = tokenizer(tokenizer_path())
    for t in TEXTS[:8] + TEXTS[9:] + ["É è Çé!! WORD,WORD. x", "naïve's it'll 'twas", "¼ ² ª µ ß ŉ İ ſ", "don’t — stop"]:
        assert [*np.frombuffer(tok.ids(t or ""), "<u4").tolist(), packing.END] == ids_of(t), t


def test_token_ids_of_all_low_characters():
    """Each character below U+0180 in several places, and random strings of them."""
    tok, rng = tokenizer(tokenizer_path()), np.random.default_rng(11)
    texts = [t for c in map(chr, range(0x180)) for t in (f"a{c}b", f"{c}a b{c}", f"ab {c} c", c * 3, f"a.{c}", f"{c}'s a'{c}")]
    for low in ([chr(k) for k in range(0x180)], list("ab \x1c\x1d\x1e\x1f\x85\xa0"), list("aB1 '\n\t.,-<|>/é")):
        texts += ["".join(rng.choice(low, int(n))) for n in rng.integers(1, 13, 500)]
    for t in texts:
        assert tok.ids(t) == tok.library(t), repr(t)


def test_token_ids_of_marks_behind_words(monkeypatch):
    """Runs of marks behind and before words, in texts that share runs, are the library's, however the runs are cut."""
    tok, rng = tokenizer(tokenizer_path()), np.random.default_rng(12)
    words = ["Word", "É", "naïve", "ſt", "x1", "1", "a_b", "it's", "don't'", ""]
    marks = ["", ".", ",!!", "***", "%%%", "'", "''s", "_", "<", "|>", "...?", "(", ")\"", "~`", "&;", "§", "'ll,"]
    texts = [None, "", " ", "İ ₂", "<|endoftext|> a"]
    for n in rng.integers(1, 30, 800):
        texts.append(" ".join(f"{m}{w}{o}" for w, m, o in zip(rng.choice(words, n), rng.choice(marks, n), rng.choice(marks, n))))
    expected = [tok.library(t or "") for t in texts]
    for run in (1, 500, 1 << 20):
        monkeypatch.setattr(tokens, "RUN_CHARS", run)
        assert list(tok.many(pa.array(texts))) == expected
    assert list(tok.many(pa.array([], pa.string()))) == []


def check_packing(rows, texts):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW and (at == rs[0].window or rs[0].window == packing.WINDOW)
    for doc, rs in by_doc.items():
        ids = ids_of(texts[doc])
        for r in rs:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
        assert sum(r.length for r in rs) % len(ids) == 0
    return by_seq


def test_packing(spark, odd, empty):
    rows = packing.pack(odd).collect()
    check_packing(rows, dict(enumerate(TEXTS)) | {None: "no id"})
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert packing.pack(empty).count() == 0
    docs = common.documents(spark, SF)
    seqs = check_packing(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    used = [sum(r.length for r in s) for s in seqs.values()]
    assert sum(packing.WINDOW - u for u in used if u & (u - 1)) < 0.03 * sum(used)


def test_packing_plan_uses_every_piece():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1, 4097, 5000).tolist() + [512] * 40 + [7] * 900)
    plan = packing.plan(counts)
    used = Counter()
    for tier, lengths, times in plan:
        assert sum(lengths) <= tier and (tier == packing.WINDOW or sum(lengths) == tier)
        used.update({n: lengths.count(n) * times for n in set(lengths)})
    assert used == counts
    where = packing.places(plan)
    assert len(set(zip(where["key"].tolist(), strict=True))) == len(where["key"])


def test_tiers_are_packed_and_steps_balanced():
    """Short pieces make full windows of their own tier, and half of them fill long windows' gaps; steps are alike."""
    rng = np.random.default_rng(6)
    counts = Counter(rng.integers(20, 500, 20_000).tolist() + rng.integers(500, 4097, 3000).tolist())
    plan = packing.plan(counts)
    tiers = Counter()
    for tier, lengths, times in plan:
        tiers[tier] += times
        if tier < packing.WINDOW:
            assert sum(lengths) == tier and packing.tier_of(lengths[0]) == tier and max(map(packing.tier_of, lengths)) == tier
    assert set(tiers) == {512, 1024, 2048, 4096}
    assert [t for t, _, _ in plan] == sorted(t for t, _, _ in plan)
    short = sum(n * c for n, c in counts.items() if n <= 512)
    assert 0.4 * short < sum(sum(x for x in lengths if x <= 512) * times for tier, lengths, times in plan if tier < packing.WINDOW) < 0.6 * short
    where = packing.places(plan, group_windows=16)
    windows, tokens = defaultdict(Counter), defaultdict(Counter)
    for n, lo, hi, seq, tier, group, groups in zip(where["length"], where["lo"], [*where["lo"][1:], 0], where["sequence"], where["tier"], where["group"], where["groups"], strict=True):
        for r in range((hi if hi > lo else counts[n]) - lo):
            step = group + (seq + r) % groups
            tokens[tier][step] += n
            windows[tier][seq + r] = step
    for tier in tokens:
        sizes = Counter(windows[tier].values())
        assert max(sizes.values()) - min(sizes.values()) <= 1
        assert max(tokens[tier].values()) <= 1.1 * min(tokens[tier].values()) + 2 * tier


def brute_simhash(rows, radius=4):
    from xxhash import xxh64_intdigest

    def fp(text):
        w = (text or "").encode().lower().split()
        h = [xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, f"{fps[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(rows))


def test_simhash(spark, odd, empty):
    docs = common.documents(spark, SF)
    want = brute_simhash([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    got = simhash.near_duplicates(odd).collect()
    some = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute_simhash(some)
    assert simhash.near_duplicates(empty).count() == 0


def brute_copies(rows):
    """Classes by exact similarity of five-word shingles, over all pairs that share a shingle, and equal words."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    up, holders, same = list(range(len(rows))), defaultdict(list), {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        up[root(i)] = root(same.setdefault(b" ".join(words[i]), i))
        shared = Counter(j for x in s for j in holders[x])
        for j, both in shared.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, least[root(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("shard,block_words", [(1024, 1 << 20), (3, 200)])
def test_near_copies(spark, odd, empty, shard, block_words):
    """All of them, with hot bands and large groups dealt to several units as well."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, nearcopies.near_copies(docs, shard=shard, block_words=block_words).collect())) == brute_copies(rows)
    assert nearcopies.near_copies(empty).count() == 0
    want = brute_copies([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    assert sorted(tuple(r) for r in nearcopies.near_copies(odd).collect()) == want


def edited(rng, words, share):
    """``words`` with a run of them replaced, appended or put in, so that about ``share`` of the words are new."""
    n, at, kind = int(len(words) * share), int(rng.integers(0, len(words))), int(rng.integers(0, 3))
    new = [f"n{x}" for x in rng.integers(0, 10**9, n)]
    return [*words, *new] if kind == 0 else [*words[:at], *new, *words[at:]] if kind == 1 else [*words[:at], *new, *words[at + n :]]


def test_near_copies_of_every_kind_are_found(spark):
    """Pairs at all similarities about 0.8: none of those at or above it is missed."""
    rng, texts = np.random.default_rng(8), []
    for k in range(700):
        base = [f"b{x}" for x in rng.integers(0, 10**9, int(rng.integers(30, 400)))]
        texts += [" ".join(base), " ".join(edited(rng, base, rng.uniform(0.02, 0.25)))]
    rows = list(enumerate(texts))
    want = brute_copies(rows)
    assert sum(i != c for i, c in want) > 300
    assert sorted(map(tuple, nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


@pytest.mark.parametrize("copies", [100, 400])
def test_copies_below_the_similarity_make_no_pairs(spark, copies, monkeypatch):
    """Edited copies of one text that are not near copies of each other: the rows passed on grow with the copies, not their pairs."""
    rng, counted = np.random.default_rng(5), []
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    texts = []
    for k in range(copies):
        at = set(rng.choice(300, 12, replace=False).tolist())
        texts.append(" ".join(f"x{k}-{i}" if i in at else w for i, w in enumerate(base)))
    real = common.staged

    def staged(df):
        out = real(df)
        counted.append(out.count())
        return out

    monkeypatch.setattr(nearcopies.common, "staged", staged)
    rows = list(enumerate(texts))
    assert sorted(map(tuple, nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), shard=64).collect())) == brute_copies(rows)
    assert max(counted) <= 4 * copies


def families(rng, groups, size, words):
    """Sets of numbers: groups of edited copies of one set, edited ones being more or less alike, and some of nothing."""
    sets = []
    for g in range(groups):
        base = rng.integers(0, 10**6, words).astype("u8") * np.uint64(97)
        for _ in range(size):
            new = rng.random(words) < rng.choice([0.0, 0.02, 0.08, 0.15])
            sets.append(np.unique(np.where(new, rng.integers(0, 10**9, words).astype("u8"), base)))
    return [*sets, np.zeros(0, "u8")]


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("sides", [False, True])
def test_links_connect_what_all_pairs_do(seed, sides):
    """The forest of a unit of work against all of its pairs, with one block of texts and with two."""
    rng = np.random.default_rng(seed)
    sets = families(rng, int(rng.integers(1, 6)), int(rng.integers(1, 60)), int(rng.integers(4, 40)))
    sets = [sets[k] for k in rng.permutation(len(sets))]
    asks = rng.random(len(sets)) < 0.5 if sides else np.zeros(len(sets), bool)
    sides = asks.any() and not asks.all()
    want, got = simhash.Forest(), simhash.Forest()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if (not sides or asks[i] != asks[j]) and both and both >= 0.8 * (len(a) + len(b) - both):
                want.join(i, j)
    links = nearcopies.similar_links(sets, asks, 0.8)
    assert all(got.join(i, j) for i, j in links)  # a forest: no link joins what is joined
    classes = lambda f: sorted(sorted(k for k in range(len(sets)) if f.root(k) == r) for r in {f.root(k) for k in range(len(sets))})
    assert classes(got) == classes(want)


def test_copies_need_few_turns():
    """Of many copies of one text only those tried first, and what is not like them, are compared with all."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 10**9, 200).astype("u8")
    sets = [np.unique(np.append(base, rng.integers(0, 10**9, 5).astype("u8"))) for _ in range(2000)]
    sets += [np.unique(np.concatenate([base[:100], rng.integers(0, 10**9, 100).astype("u8")])) for _ in range(5)]
    turns, real = [], np.bincount

    def counted(x, **more):
        turns.append(len(x))
        return real(x, **more)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(nearcopies.np, "bincount", counted)
        assert len(nearcopies.similar_links(sets, np.zeros(len(sets), bool), 0.8)) == 1999
    assert len(turns) <= 1 + nearcopies.TRIED


def test_near_copies_of_one_text(spark):
    """Edited copies of a text, and texts that share half of its words: the copies meet, the others stay."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    texts = [" ".join(base)]
    for k in range(40):
        at = rng.integers(0, 400, 2)
        texts.append(" ".join(f"x{k}" if i in at else w for i, w in enumerate(base)))
    texts += [" ".join(base[:200] + [f"y{k}{i}" for i in range(200)]) for k in range(10)]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == k for k in range(41, 51))


@pytest.mark.parametrize("shard,per_key", [(8, 1), (4096, 64), (16, 10**6)])
def test_bk_trees_lose_no_class(spark, shard, per_key):
    """Hot keys dealt to shards, and more shared blocks, find the same classes."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**63))
    fps = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (120, 3))} | {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = sorted(fps)
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    prints = spark.createDataFrame([(simhash._signed(f), k) for k, f in enumerate(fps)], "fp long, node long")
    found = {r.node: r.root for r in components(simhash.links(prints, shard=shard, per_key=per_key)).collect()}
    assert [found.get(k, k) for k in range(len(fps))] == [root(k) for k in range(len(fps))]


def test_masks_cover():
    rng = np.random.default_rng(2)
    for shared in (1, 2, 3):
        ms = simhash.masks(shared)
        assert len(ms) == math.comb(4 + shared, shared)
        for _ in range(200):
            d = sum({1 << int(b) for b in rng.integers(0, 64, 4)})
            assert any(not d & m for m in ms)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_quality(spark, odd, empty):
    docs, labels = common.documents(spark, "/root/testdata/sf0.01"), common.documents(spark, "/root/testdata/sf0.01", "labels")
    taught = labels.where("crc32(cast(doc_id as string)) % 4 <> 2")
    rows = quality.score(docs, taught).join(labels.where("crc32(cast(doc_id as string)) % 4 = 2"), "doc_id").collect()
    assert len(rows) > 50 and sum(r.keep == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    none = labels.limit(0)
    assert quality.score(odd, none).where("keep").count() == odd.count()
    assert set(odd.columns) <= set(quality.score(odd, labels).columns) and quality.score(odd, labels).count() == odd.count()
    assert quality.score(empty, labels).count() == 0


def plain_views(text, lang, source, n_chars):
    """Both views of a document counted one by one."""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    pairs = np.zeros(quality.TEXT_DIMS)
    for a, b in zip(raw, raw[1:]):
        pairs[(a * 131 + b) % quality.TEXT_DIMS] += 1
    n, w = max(1, len(text)), max(1, len(words))
    among = lambda low, high: sum(low <= b <= high for b in raw)
    upper, lower, digits, high = among(65, 90), among(97, 122), among(48, 57), among(128, 255)
    spaces, stops = raw.count(b" ") + raw.count(b"\n"), raw.count(b".") + raw.count(b",")
    marks, kinds = len(raw) - upper - lower - spaces - digits - high, len(set(words))
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    counts = [math.log1p(n), math.log1p(w), math.log1p(len(lines)), math.log1p(w / len(lines)), kinds / w, kinds / w**0.7, len(set(lines)) / len(lines)]
    counts += [upper / max(1, upper + lower), marks / w, (marks - stops) / w, stops / w, digits / n, spaces / n, n / w + doubled / w]
    page = {zlib.crc32(("=" + lang).encode() if lang is not None else b"") % 64: 1, 64 + zlib.crc32(("=" + source).encode() if source is not None else b"") % 64: 1}
    page |= {128 + min(23, len(bin(n_chars or 0)) - 2 if n_chars else 0): 1, 152: math.log1p(n_chars or 0), 153: n_chars is None}
    return [*(math.sqrt(p / max(1, sum(pairs))) for p in pairs), *counts], [page.get(k, 0) for k in range(154)]


def test_quality_against_a_plain_version(spark):
    """Features counted plainly, and models applied and trained by the formulas alone; the page view never sees the text."""
    docs, labels = common.documents(spark, SF), common.documents(spark, SF, "labels")
    rows, told = docs.collect(), {r.doc_id: r.quality for r in labels.collect()}
    seen = {}
    for r in rows:
        if len(r.text or "") < 20_000:
            plain = plain_views(r.text or "", r.lang, r.source, r.n_chars)
            seen[r.doc_id] = plain
            for a, b in zip(quality.views(r.text, r.lang, r.source, r.n_chars), plain, strict=True):
                assert np.allclose(a, b, atol=1e-9)
    few = docs.where(F.col("doc_id").isin(list(seen)))
    model = quality.fit(few, labels)
    # the same models from plain features
    ids = sorted(i for i in told if i in seen)
    free = sorted(set(seen) - set(ids))
    stack = lambda at, v: np.array([np.array(seen[i][v], "f4") for i in at], "f8")
    again = quality.co_train(stack(ids, 0), stack(ids, 1), np.array([int(told[i] > 0) for i in ids]), stack(free, 0), stack(free, 1))
    assert np.allclose(model["share"], again["share"], atol=1e-5)
    for m, (a, b), v in zip(model["views"], model["fit"], (0, 1), strict=True):
        x = stack(ids, v)
        assert np.allclose(a * m.logit(x) + b, again["fit"][v][0] * again["views"][v].logit(x) + again["fit"][v][1], atol=1e-3)
    for r in quality.score(few, labels).collect():
        z = 0
        for v, m in enumerate(model["views"]):
            by_hand = sum(w * min(8, max(-8, (x - c) / s)) for w, x, c, s in zip(m.w, seen[r.doc_id][v], m.mean, m.scale)) + m.w[-1]
            z += model["share"][v] * min(30, max(-30, by_hand * model["fit"][v][0] + model["fit"][v][1]))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.keep == (r.score >= 0.5)


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 6)), (rng.random(300) < 0.3).astype("i8")
    m = quality.Logistic(x, y, 2.0, steps=50)
    each = np.where(y == 1, 150 / y.sum(), 150 / (y == 0).sum())
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((300, 1))])
    grad = z.T @ (each * (1 / (1 + np.exp(-z @ m.w)) - y)) + np.array([2.0] * 6 + [1e-6]) * m.w
    assert np.abs(grad).max() < 1e-6


def test_views_teach_each_other():
    """Text tells the class at once; the page view learns it from what the text view labels."""
    rng = np.random.default_rng(3)
    make = lambda n: (y := rng.integers(0, 2, n), rng.normal(size=(n, 20)) + 3 * y[:, None], np.eye(8)[2 * rng.integers(0, 4, n) + y])
    (y, t, p), (_, ft, fp), (ty, tt, tp) = make(24), make(400), make(400)
    right = lambda m: ((m["views"][1].logit(tp) > 0) == ty).mean()
    assert right(quality.co_train(t, p, y, ft, fp)) >= right(quality.co_train(t, p, y, ft[:0], fp[:0])) and right(quality.co_train(t, p, y, ft, fp)) > 0.95


def test_labels_of_other_documents_take_no_place(spark, monkeypatch):
    """Labels of many documents that are not there don't crowd out those that are, nor repeated rows; the worst of several labels counts."""
    monkeypatch.setattr(quality, "LABELLED", 150)
    docs = common.documents(spark, SF)
    labels = common.documents(spark, SF, "labels").select("doc_id", "quality")
    more = labels.unionByName(spark.range(10**6, 10**6 + 20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))).unionByName(labels.withColumn("quality", F.lit(1)))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.score(d, x).collect()) for d, x in ((docs, labels), (docs.union(docs), more)))
    assert a == sorted(set(b)) and len({s for _, s in a}) > 50


def test_mixing(spark, odd, empty):
    rows = mixing.mix(odd).orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(odd.count()))
    assert mixing.mix(empty).count() == 0
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"))
    rows = mixing.mix(docs, {"a": 1, "b": 1, "c": 2}, block=4).orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(3000)) and len({r.doc_id for r in rows}) == 3000
    run = Counter()
    for t, r in enumerate(rows[:480], 1):  # c has 300 rows: it lasts about 600
        run[r.source] += 1
        assert all(abs(run[s] - share * t) < 2 * 4 for s, share in zip("abc", (0.25, 0.25, 0.5), strict=True))  # a block, and one under way


def test_mixing_keeps_to_the_true_weights():
    """A third for one of many sources, over many blocks: never a block from its share."""
    for others in (19, 99, 255):
        weights = np.array([1 / 3] + [2 / 3 / others] * others)
        counts = np.ceil(weights * 100_000).astype("i8") * 16 + 5
        placer = mixing.Placer(counts.tolist(), weights.tolist())
        for s in (0, 1, others):
            _, slots = placer.positions(np.full(counts[s] // 16, s), np.arange(counts[s] // 16) * 16)
            slots = slots[slots < 90_000]
            j = np.arange(len(slots))
            assert (slots >= np.floor(j / weights[s] + 1e-6) - 1e-6).all() and (slots + 1 <= np.ceil((j + 1) / weights[s] - 1e-6) + 1e-6).all()
    blocks = np.array([1, 7, 300, 40, 3])
    slots, w = mixing.schedule(blocks, np.array([0.1, 3, 2, 0.5, 9])), np.array([0.1, 3, 2, 0.5, 9])
    assert sorted(slots.tolist()) == list(range(351))
    run, fluid, owner = np.zeros(5), np.zeros(5), np.repeat(np.arange(5), blocks)[np.argsort(slots)]
    for s in owner:
        run[s] += 1
        room = 1.0
        while room > 1e-12:  # a slot of the fluid mix, cut where a source is used up
            rate = np.where(blocks - fluid > 1e-9, w, 0)
            rate = rate / rate.sum()
            step = min(room, *((blocks - fluid)[rate > 0] / rate[rate > 0]))
            fluid, room = fluid + rate * step, room - step
        assert (np.abs(run - fluid) < 1 + 1e-6).all()


def brute_best(v, ids, asks, k, score):
    out = []
    for q in asks:
        s = sorted(((-score(v[q], v[i]), ids[i]) for i in range(len(v)) if i != q), key=lambda x: x)[:k]
        out += [(ids[q], n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return out


def recall(table, got, every=50, k=5):
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    v, ids = np.array([r.embedding for r in rows], "f8"), [r.vec_id for r in rows]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    mine, hits = defaultdict(list), 0
    for r in sorted(got, key=lambda r: r.rank):
        mine[r.query_id].append(r)
    asked = [i for i in range(len(ids)) if ids[i] % every == 0]
    for q in asked:
        s = u @ u[q]
        s[q] = -2
        want = {ids[j] for j in np.argsort(-s, kind="stable")[:k]}
        found = mine[ids[q]]
        assert [r.rank for r in found] == list(range(1, k + 1))
        assert all(abs(r.score - s[ids.index(r.vec_id)]) < 1e-12 for r in found)
        hits += len(want & {r.vec_id for r in found})
    return hits / (k * len(asked))


def shares(monkeypatch):
    """How much of the table is scored for each query and curve, as the width of the windows tells."""
    seen, real = [], ann.window_width
    monkeypatch.setattr(ann, "window_width", lambda at, every, k: seen.append((real(at, every, k), at.where("curve = 0").agg(F.max("bucket")).first()[0] + 1)) or seen[-1][0])
    return seen


@pytest.mark.parametrize("stretch", [8192, 300])
def test_ann_recall(spark, stretch):
    table = common.documents(spark, "/root/testdata/sf0.1", "embeddings")
    assert recall(table, ann.search(table, stretch=stretch).collect()) >= 0.9


def test_ann_windows_are_narrow_on_clustered_vectors(spark, monkeypatch):
    """Where vectors have structure, the curves find it: recall of 0.9 while a tenth of the rows is scored on a curve."""
    rng, seen = np.random.default_rng(4), shares(monkeypatch)
    centres = rng.normal(size=(150, 64))
    v = centres[rng.integers(0, 150, 9000)] + 0.35 * rng.normal(size=(9000, 64))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = recall(table, ann.search(table, stretch=2048).collect())
    width, buckets = seen[0]
    print("recall", found, "share of rows a curve", (2 * width + 1) / buckets)
    assert found >= 0.9 and (2 * width + 1) / buckets < 0.1


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], None), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [-1.0], 1), (None, [1.0, 1.0], 1), (100, [0.5, 0.5, 0.5], 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vectors_odd(spark):
    d = odd_vectors(spark)
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(d).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 8), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 8)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(d).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(0, 1, 2, 8192), (0, 2, 1, 4096), (0, 3, 100, 2048), (0, 4, 4, 0), (0, 5, 8, -4096)]
    assert ann.search(d.limit(0)).count() == 0 and topk.search(d.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [16_384, 300])
def test_topk_is_exact(spark, shard):
    table = common.documents(spark, SF, "embeddings")
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    v = np.floor(64 * np.array([r.embedding for r in rows], "f8")).astype("i8")
    want = brute_best(v, list(range(len(rows))), range(0, len(rows), 20), 20, lambda a, b: int(a @ b))
    assert sorted(map(tuple, topk.search(table, shard=shard).collect())) == sorted(want)


def test_mtree_prunes_and_ties():
    rng = np.random.default_rng(3)
    v = np.concatenate([np.floor(rng.normal(0, 3, (3000, 4))), np.ones((1000, 4))])
    tree = topk.MTree(v, np.arange(4000))
    for q in (0, 5, 3500):
        s = v @ v[q]
        want = sorted((-int(s[i]), i) for i in range(4000) if i != q)[:20]
        assert [(-a, b) for a, b in tree.search(v[q], q, 20)] == want


def test_hilbert_is_a_walk():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = ann.hilbert(side, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def plain_phrases(text, sample):
    """Longest matches, one after another; a byte that the sample lacks is one."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample and text[at:end] in sample:
            end += 1
        n, at = n + 1, end
    return n


def test_cross_parsing_toy():
    parser = langid.CrossParser({"a": ["banana bandana cabana"], "b": ["日本 é", "q"], "c": [""], "d": ["x"], "e": ["naïve हिन्दी"]})
    samples = [b" " + b"".join(langid.letters(t)[1:] for t in s) for s in (["banana bandana cabana"], ["日本 é", "q"], [""], ["x"], ["naïve हिन्दी"])]
    texts = [langid.letters(t) for t in ("banana", "bandcab", " xyz ", "anax", "nab nad ", "q", "日é本 हिन", "x" * 300)]
    got = parser.phrases(texts)
    assert got.tolist() == [[plain_phrases(t, s) for t in texts] for s in samples]
    assert langid.letters("½ ² Ⅷ ① 12 ́") == b"" and langid.letters("हिन्दी") == " हिन्दी ".encode()


def test_whole_texts_are_cross_parsed(spark):
    """Every text of the table, parsed plainly against the same sample."""
    docs = common.documents(spark, SF)
    samples = langid.sample(docs)
    taught = {r.text for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert all(t in taught for texts in samples.values() for t in texts)
    joined = {k: b" " + b"".join(langid.letters(t)[1:] for t in v) for k, v in samples.items()}
    said = {r.doc_id: r for r in langid.identify(docs, samples).collect()}
    for r in docs.collect():
        text = langid.letters(r.text)
        if not text:
            assert (said[r.doc_id].lang_pred, said[r.doc_id].score) == ("und", 0)
            continue
        if len(text) > 2500:
            continue
        entropy = {k: plain_phrases(text, s) * math.log2(len(s)) / len(text) for k, s in joined.items()}
        best = min(sorted(entropy), key=entropy.get)
        assert said[r.doc_id].lang_pred == best
        assert abs(said[r.doc_id].score - 1 / sum(2 ** (entropy[best] - e) for e in entropy.values())) < 1e-9


def test_langid(spark, odd, empty):
    docs = common.documents(spark, "/root/testdata/sf0.01")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    got = {r.doc_id: r for r in langid.languages(odd).collect()}
    assert langid.languages(odd).count() == odd.count()
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 5, 10)) and got[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items() if k is not None)
    assert langid.languages(empty).count() == 0
    assert langid.known_language(odd).columns == odd.columns


def test_language_that_cannot_be_told(spark):
    rows = [(k, f"shared tok {w} {w}ing {w}est", lang, "s", 9) for k, (lang, w) in enumerate([("a", "kora"), ("b", "miluf")] * 20)]
    docs = spark.createDataFrame([*rows, (100, "shared", None, "s", 6), (101, "kora koraing", None, "s", 12), (102, "miluf", None, "s", 5), (103, "12 !", None, "s", 4), (104, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in langid.known_language(docs).collect()}
    assert kept == {*range(40), 101, 102}
    one = docs.where("lang is null or lang = 'a'")
    assert {r.doc_id for r in langid.known_language(one).collect()} == {*range(0, 40, 2), 100, 101, 102}


def test_mixing_of_odd_weights(spark):
    """Weights of zero, below zero, not finite and of no source: every row still has a place."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    for weights in ({"s0": 0.0, "s1": -1.0, "s2": float("nan"), "s3": float("inf"), "s4": 2.0}, {"s0": 0.0}, {"none": 1.0}, {}):
        assert sorted(r.mix_position for r in mixing.mix(docs, weights).collect()) == list(range(300)), weights
    few = mixing.mix(docs, blocks=10).collect()
    assert max(r.mix_block for r in few) < 15 and sorted(r.mix_position for r in few) == list(range(300))


def test_hot_text_keeps_ranges_few(spark, monkeypatch):
    """A text of half the bytes among 20,000 groups: the driver sees ranges of hashes, far fewer than groups."""
    rng, seen = np.random.default_rng(9), []
    h = rng.integers(-(2**63), 2**63 - 1, 20_000)
    b = rng.integers(1, 1000, 20_000)
    b[7] = b.sum()
    real = sharding.capacity
    monkeypatch.setattr(sharding, "capacity", lambda totals, shards: seen.append(len(totals)) or real(totals, shards))
    begin = [x - 2**63 for x in sharding.boundaries(spark.createDataFrame(list(zip(h.tolist(), b.tolist(), strict=True)), "h long, bytes long"), 8)]
    sums = Counter()
    for k, s in zip(h.tolist(), b.tolist(), strict=True):
        sums[sum(k >= x for x in begin)] += s
    order = np.argsort(h)
    assert max(sums.values()) == real(b[order], 8) and max(seen) < 5000
    text = "hot " * 5000
    rows = sharding.shard(spark.createDataFrame([(k, text if k % 2 else f"t{k}") for k in range(400)], "doc_id long, text string")).collect()
    assert len({r.shard for r in rows if r.doc_id % 2}) == 1 and sorted(r.doc_id for r in rows) == list(range(400))


def test_sharding(spark, odd, empty):
    docs = common.documents(spark, SF).select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = sharding.shard(docs, 5).collect()
    assert len(rows) == docs.count()
    slots, homes, sizes = defaultdict(list), defaultdict(set), Counter()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert sum(sizes.values()) == sum(r.size for r in rows) and texts
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_are_minimax(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    h = sorted({int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)} | ({-(2**63) + int(x) for x in rng.integers(0, 5000, 60)} if seed % 2 else set()))
    b = [int(x) for x in rng.integers(1, 10**5, len(h))]
    if seed > 1:
        b[len(b) // 3] = 10**7
    groups = spark.createDataFrame(list(zip(h, b, strict=True)), "h long, bytes long")
    begin = [x - 2**63 for x in sharding.boundaries(groups, 8)]
    sums = Counter()
    for k, s in zip(h, b, strict=True):
        sums[sum(k >= x for x in begin)] += s
    assert max(sums.values()) == sharding.capacity(np.array(b), 8)
    lo = max(max(b), -(-sum(b) // 8))  # no smaller capacity works
    cap = sharding.capacity(np.array(b), 8)
    if cap > lo:
        at = done = 0
        for s in b:
            at, done = (s, done + 1) if at + s > cap - 1 else (at + s, done)
        assert done + 1 > 8


def test_binary(spark, odd, empty, tmp_path):
    binary.write(odd, f"file://{tmp_path}/m", block_tokens=20_000)
    rows = spark.read.parquet(f"file://{tmp_path}/m").collect()
    assert len({r.row_id for r in rows}) == len(rows)
    back = defaultdict(dict)
    for r in rows:
        ids, at = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(at) == binary.WINDOW and r.cu_seqlens[-1] <= binary.WINDOW
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k : k + 2]
            assert at[a:b].tolist() == list(range(b - a))
            back[d].setdefault(s, []).append(ids[a:b].tolist())
    for d, t in [*enumerate(TEXTS), (None, "no id")]:
        assert sum((back[d][s][0] for s in sorted(back[d])), []) == ids_of(t)
    assert len(back[2][0]) == 3 and binary.packed(empty).count() == 0


def test_digests_of_the_registered_query(spark, odd, empty):
    """What op8 returns, from ids of the library alone: each id in one segment, segments gapless, the packing best fit decreasing."""
    docs = common.documents(spark, SF)
    for got, texts in ((queries.op8_binary(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()]), (binary.digests(binary.packed(odd)).collect(), [(r.doc_id, r.text) for r in odd.collect()])):
        want = Counter()
        for doc, text in texts:
            ids = ids_of(text)
            for at in range(0, len(ids), binary.WINDOW):
                part = ids[at : at + binary.WINDOW]
                want[doc, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
        by_row = defaultdict(list)
        for r in got:
            by_row[r.row_id].append(r)
        for rs in by_row.values():
            rs.sort(key=lambda r: r.segment)
            assert [r.segment for r in rs] == list(range(len(rs))) and [r.offset for r in rs] == np.cumsum([0, *(r.length for r in rs)]).tolist()[:-1]
            assert sum(r.length for r in rs) <= binary.WINDOW
    assert binary.digests(binary.packed(empty)).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 101, 400).tolist()
    rows = binary.best_fit(lengths, 100)
    rooms, want = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(100 - n)
            want += 1
    assert sorted(i for r in rows for i in r) == list(range(400)) and max(sum(lengths[i] for i in r) for r in rows) <= 100
    assert len(rows) == want and sorted(100 - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site, the best</h1></header><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, many of them, all of the time, for ever and ever.</div>
<div id=page><div class=content><h2>Head&amp;line</h2><p>First   para, with &lt;tags&gt; and a <a href=#>link</a>,
and more words, to be sure.</p><p>Second<br>para &eacute;t&eacute;, long enough to be counted as a paragraph of text.<ul><li>item one, plain</li><li>item two</ul>
<blockquote>Quoted, words, of, some, length, that, matter</blockquote><form><p>Subscribe, please, now, or, never</p></form></div>
<div class="comments"><p>First comment, of a reader, that is long, and has commas, many, many.</p></div></div>
<aside><p>Aside, aside, aside, with commas, and a good length of text as well.</p></aside><footer><p>&copy; Footer</p></footer></body></html>"""


def test_html(spark):
    want = "Head&line\nFirst para, with <tags> and a link, and more words, to be sure.\nSecond para été, long enough to be counted as a paragraph of text.\nitem one, plain\nitem two\nQuoted, words, of, some, length, that, matter"
    assert html.main_text(PAGE) == want
    for bad in (None, "", "<p", "<!--", "</p></p>", "<script>x", "<a href='", "<div>" * 50_000, "<nav><p>menu, menu, menu</p></nav>"):
        assert html.main_text(bad) == ""
    assert html.main_text("1 < 2, <") == "1 < 2, <"  # what begins no tag is text
    assert html.main_text("<p>One &am") == "One &am" and html.main_text("plain, text") == "plain, text"
    assert html.main_text("<article><p>Tiny.</p></article><footer><p>Long, long, long, long footer text, with commas</p></footer>") == "Tiny."
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extract(rows).collect()
    assert [r.text for r in got] == [want, want, ""] and [r.n_chars for r in got] == [len(want), len(want), 0]
    assert html.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["article", "div", "section class=x", "none"])
def test_pages(spark, tag):
    """The test pages' articles, taken out by their own tags; found as well if other tags, or none, take their place."""
    import re
    from html import unescape

    for r in common.documents(spark, SF, "pages").collect():
        body = r.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        lines = (" ".join(unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body))
        page = r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")
        if tag == "none":
            page = r.html.replace("<article>", "").replace("</article>", "")
        assert html.main_text(page) == "\n".join(x for x in lines if x), r.page_id


def test_articles_are_kept_whole():
    """Reference lists, labels, and elements whose names only sound like furniture's, with and without an <article>."""
    para = "<p>A paragraph, of some length, with commas, and more words, to be sure that it is one.</p>"
    inner = (
        "<h1>Title</h1>" + para + '<div id="login-flow"><p>The login flow.</p></div><div class="social-history"><p>History, of society.</p></div>'
        '<p class="notice-period">Two weeks.</p><label>A label.</label>' + para + "<ul><li><a href=1>A long title of a paper, 2014</a></li><li><a href=2>Another long title of one</a></li></ul>"
    )
    want = ["Title", "A paragraph, of some length, with commas, and more words, to be sure that it is one.", "The login flow.", "History, of society.", "Two weeks.", "A label."]
    want = "\n".join([*want, want[1], "A long title of a paper, 2014", "Another long title of one"])
    around = '<div class="ad-slot"><p>Buy this, buy that.</p></div><div id=comments><p>A comment, of a reader, who has a lot, really a lot, to say.</p></div><div class="site-footer">Foot</div>'
    for tag in ("article", "div", "section", "main"):
        assert html.main_text(f"<body><nav>Menu</nav><{tag}>{inner}</{tag}>{around}</body>") == want, tag
    sections = "".join(f"<section><h2>Part {k}</h2>{para * (1 + 5 * (k == 2))}</section>" for k in range(4))
    deep = "<div>" * 12 + sections + "</div>" * 12
    got = html.main_text(f"<body>{deep}{around}</body>").split("\n")
    assert [x for x in got if x.startswith("Part")] == [f"Part {k}" for k in range(4)] and len(got) == 4 + 9
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    assert html.main_text(f"<body>{menu}<h1>Title</h1>{para}{menu}</body>") == "Title\n" + want.split("\n")[1]
    assert html.main_text(f'<body><div class="sidebar main">{para * 9}</div><p>Foot.</p></body>').count("A paragraph") == 9


def test_deeply_nested_pages_take_linear_time():
    for n in (20_000,):
        assert html.main_text("<ul><li>text, and so on " * n).count("text") == n
        assert html.main_text("<div>text, and " * n).count("text") == n


def test_html_of_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<p>One, two.</p>", "mine", "x")], "page_id int, url string, html string, text string, n_chars string")
    assert [tuple(r) for r in html.extract(rows).collect()] == [(1, "u", "One, two.", 9)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = c.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)


def test_repeated_vectors_count_once(spark):
    """Every row twice and one row forty times: the neighbours are those of the table without repeats."""
    table = common.documents(spark, SF, "embeddings").select("vec_id", "embedding").limit(200)
    once = spark.createDataFrame(table.collect(), table.schema)
    many = once.unionByName(once)
    for _ in range(38):
        many = many.unionByName(once.where("vec_id = 7"))
    for search in (topk.search, ann.search):
        assert sorted(map(tuple, search(many).collect())) == sorted(map(tuple, search(once).collect()))


def test_mixing_of_many_sources(spark):
    """Small sources beyond the 255 largest get their stated weight too, each less than a block from its share."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, F.concat(F.lit("small"), F.col("id") % 4)).otherwise(F.concat(F.lit("s"), F.col("id") % 300)).alias("source"))
    sources = {f"s{k}": 1.0 for k in range(300)} | {"small0": 60.0, "small1": 40.0, "small2": 20.0, "small3": 80.0}
    rows = mixing.mix(docs, sources, block=2).orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(20_000)) and len({r.doc_id for r in rows}) == 20_000
    run = Counter()
    for t, r in enumerate(rows[:480], 1):  # small3, 100 rows at 80 of 500, lasts 625
        run[r.source] += 1
        assert all(abs(run[s] - sources[s] / 500 * t) < 2 * 2 for s in sources)
