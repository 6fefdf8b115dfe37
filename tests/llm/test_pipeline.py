import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gridshift.llm import common, langid, quality  # noqa: E402

from .test_ops import SF, brute_copies, check_packing  # noqa: E402


def test_pipeline_against_plain_stages(spark):
    """Each stage's rows, told from its own input by a plain version of it."""
    docs = common.documents(spark, SF)
    columns = docs.columns
    taken = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(spark, docs, SF))
        taken[name] = (docs.collect(), out.collect())
        docs = out
        if name != "packing":
            assert out.columns == columns
    first = common.documents(spark, SF)
    model = quality.fit(first, common.documents(spark, SF, "labels"))
    keep = []
    for r in taken["quality classifier"][0]:
        z = sum(share * (a * float(m.logit(v[None])[0]) + b) for share, (a, b), m, v in zip(model["share"], model["fit"], model["views"], quality.views(r.text, r.lang, r.source, r.n_chars), strict=True))
        keep += [r.doc_id] if z >= 0 else []
    assert sorted(keep) == sorted(r.doc_id for r in taken["quality classifier"][1])
    before, after = taken["language ID"]
    parser = langid.CrossParser(langid.sample(spark.createDataFrame(before, first.schema)))
    told = dict(zip((r.doc_id for r in before), parser.predict([r.text for r in before]), strict=True))
    assert sorted(r.doc_id for r in after) == sorted(k for k, (lang, score) in told.items() if lang != "und" and score >= langid.CLEAR / len(parser.langs))
    before, after = taken["SimHash near-dedup"]
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in brute_copies([(r.doc_id, r.text) for r in before])})
    before, after = taken["mixing sources to target weights"]
    assert sorted(before) == sorted(after)
    before, after = taken["packing"]
    check_packing(after, {r.doc_id: r.text for r in before})
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_repeated_ids_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (3, "f g h i j", "en", "s", 9), (None, "a b c d e", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [0, 1, 3]


def test_rows_of_one_id_are_told_apart_by_text(spark):
    """A doc_id with two texts, one of which is a copy of a smaller document's: only that row goes."""
    lone, copy = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, copy, "en", "s", 9), (5, lone, "en", "s", 9), (5, copy, "en", "s", 9), (5, lone + " end", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert len(kept) == 2 and kept[0] == (1, copy) and kept[1][0] == 5 and kept[1][1].startswith("a0")


def test_clashing_columns_keep_their_values(spark):
    """Extra columns named like what an operator makes come out of each stage as they went in."""
    extra = ("Score", "keep", "text_score", "lang_pred", "mix_position", "component_id")
    docs = common.documents(spark, SF)
    docs = docs.withColumns({c: docs.doc_id + k for k, c in enumerate(extra)})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id + k for r in rows for k, c in enumerate(extra)), name


def test_empty_corpus(spark):
    docs = common.documents(spark, SF).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    """One document in ten is of source b, which weighs a quarter of the mix: so the first sequences hold it."""
    rows = [(k, "word " * (20 + k // 10 * 7919 % 180), "en", "b" if k % 10 == 0 else "a", 9) for k in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in placed) == list(range(6000))
    assert len({(r.sequence_id, r.offset) for r in placed}) == 6000 and len({(r.sequence_id, r.step_group) for r in placed}) == len({r.sequence_id for r in placed})
    last = max(r.sequence_id for r in placed)
    for part in (0.1, 0.2, 0.3):
        prefix = [r.doc_id for r in placed if r.sequence_id < part * last]
        assert abs(sum(d % 10 == 0 for d in prefix) / len(prefix) - 0.25) < 0.04, part
