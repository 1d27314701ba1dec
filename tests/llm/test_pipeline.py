"""The pipeline on a small corpus with planted junk, copies and secrets."""

import random

from stateweave.llm.store import stored


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(3)
    clean = lambda: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(60))
    rows = [(i, clean(), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, "### $$$ %%% &&& " * 20, "en", "s0") for i in range(5)]
    rows += [(200 + i, rows[i][1] + " end", "en", "s1") for i in range(10)]
    rows[20] = (20, rows[20][1] + ' token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" more', "en", "s2")
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, str(tmp_path)))
        if name != "tokens":
            assert out.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name], docs = out, out
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["quality rules"] == {r[0] for r in rows if not 100 <= r[0] < 200}
    assert ids["near-duplicates"] == set(range(60))
    assert seen["secrets"].where("text LIKE '%token = \"[secret]\" more'").count() == 1 and ids["secrets"] == set(range(60))
    assert ids["mix"] <= set(range(60)) and seen["mix"].where("n_chars <> length(text)").count() == 0
    assert seen["tokens"].where("n_tokens = size(ids)").count() == seen["mix"].count() == corpus_pipeline.run(spark, str(tmp_path)).count()


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty, repeated and very long texts, equal ids, a clashing extra column; then an empty table."""
    import corpus_pipeline

    rnd = random.Random(4)
    clean = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, clean(60), "en", f"s{i % 2}", 300) for i in range(24)]
    rows += [(None, clean(60), "en", "s0", 300), (100, None, "en", "s0", 0), (101, "", None, None, None), (102, " \n\t", "de", "s1", 3), (103, clean(60), None, None, None)]
    rows += [(3, clean(60), "en", "s1", 300), rows[5], rows[5], (104, clean(60_000), "en", "s1", None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, sw_0 string"
    docs = spark.createDataFrame([(*r, "x") for r in rows], schema)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "sw_0"]
        seen[name] = docs
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert ids("quality rules") == {*range(24), None, 103, 104}
    assert ids("near-duplicates") == ids("secrets") == ids("quality rules")
    assert seen["near-duplicates"].where("doc_id = 5").count() == 1 and seen["near-duplicates"].where("doc_id = 3").count() == 2
    assert seen["secrets"].where("doc_id = 104").count() == 1 and seen["mix"].where("text IS NULL OR text = ''").count() == 0
    assert seen["tokens"].where("n_tokens = 0").count() == 0 and seen["tokens"].count() == seen["mix"].count()
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stored(stage(spark, empty, str(tmp_path)))
        assert empty.count() == 0, name
