"""The pipeline against a plain version built from the operators' plain rules."""

import corpus_pipeline
from test_substring_dedup import plain as plain_repeats
from test_text_operators import plain_components, plain_contamination, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_by_plain_rules(spark):
    import itertools

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "lang")
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5
    kept = stages["language_id"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()

    rows = {r.doc_id: r for r in kept.collect()}
    fps = {i: plain_fingerprint(r.text) for i, r in rows.items()}
    parts = plain_components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    single = stages["simhash_dedup"](spark, kept, SF).cache()
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == {i for i, c in parts.items() if i == c}

    before = [(r.doc_id, r.text) for r in single.collect()]
    expected = plain_repeats(before, 50)
    unique = stages["substring_dedup"](spark, single, SF).cache()
    assert unique.columns == docs.columns
    after = {r.doc_id: r for r in unique.collect()}
    for i, (n, gone, _) in expected.items():
        assert (i in after) == (not n or gone < n)
        if i in after:
            assert len(after[i].text.split()) == n - gone and after[i].n_chars == len(after[i].text)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, unique, SF).cache()
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    for i, r in after.items():
        n, hit, _ = plain_contamination(r.text, bench)
        assert (i in left) == (hit <= 0.5 * n)
        if i in left and not hit:
            assert left[i] == r.text
    pieces = stages["packing"](spark, clean, SF).collect()
    assert {p.doc_id for p in pieces} == set(left)


def test_run_on_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_ = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, long_, "en", None, 5), (2, long_, None, "s", None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "the cat sat", "en", "s", 1), (5, "der Hund und die Katze", "de", "s", 1), (5, "der Hund und die Katze", "de", "s", 1)]
    for name, part in (("a", rows), ("b", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert (len(out) > 0) == bool(part)
        if part:
            assert 2 not in {r.doc_id for r in out} and 1 in {r.doc_id for r in out}


def test_further_columns_go_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).drop("n_chars").selectExpr("*", "source AS t", "lang AS k", "'x' AS many", "1 AS fp", "2 AS n_words", "null AS score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(r.t == r.source and r.k == r.lang and (r.many, r.fp, r.n_words, r.score) == ("x", 1, 2, None) for r in rows), name
