"""The pipeline's stages against plain versions of what they drop."""

import corpus_pipeline
from tests.llm import brute
from tidemark.llm.shared import table


def _pairs(df):
    return sorted((r[0], r[1]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(names) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
    before, good, lines, apart, clean = (_pairs(d) for d in [table(spark, sf_dir, "documents"), *kept[:4]])
    assert 0 < len(good) < len(before) and set(good) <= set(before)
    gone = brute.lines(good)
    want = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k][1])) for k, t in good]
    want = [(k, t) for (k, t), (_, old) in zip(want, good) if t.strip() or not gone[k][1]]
    assert len(set(lines) ^ set(want)) <= 0.01 * len(want)
    near = brute.near(lines)
    assert apart == [(k, t) for k, t in lines if near[k][1] == k]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    bad = brute.contamination(apart, items)
    assert clean == [(k, t) for k, t in apart if not bad[k][4]]
    assert kept[4].count() == len(clean)
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r) for r in kept[4].collect()}


def test_empty_tables_and_nulls(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0)], docs.schema)
    for d in (docs.limit(0), nulls):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, d, sf_dir).count() <= d.count()


def test_rows_that_stay(spark, sf_dir):
    """Rows without an id, empty and null texts, repeated rows and columns with other stages' names pass every filtering stage whole."""
    import random

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(500)]
    text = lambda: " ".join(rng.choices(words, k=60))
    same = text()
    schema = table(spark, sf_dir, "documents").schema.simpleString()[7:-1].replace(":", " ") + ", quality_score string, lines_removed string, component_id string, id string, n string"
    rows = [(None, text()), (None, None), (1, None), (2, ""), (3, same), (3, same), (5, text()), (6, text())]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for k, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        got = sorted(((r.doc_id or 0, r.text or "") for r in out.collect()))
        keep = [(k or 0, t or "") for k, t in rows]
        assert set(got) >= {x for x in keep if x[1] != same} and {k for k, _ in got} == {k for k, _ in keep}, name
        assert out.columns == docs.columns or name == "line_dedup"
