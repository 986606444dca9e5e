from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, pii_bootstrap, quality_zdict, trie_join
from textloom.llm.queries import id_fold

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < 4:
            assert docs.columns == names
            seen.append({r.doc_id: r.text for r in docs.collect()})
    whole, good, distinct, unseen, hidden = seen
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    original = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_zdict.fit_quality(original, labels.where(id_fold(3) != 1))
    scored = {r.doc_id: r.quality_score for r in quality_zdict.score_quality(original, model).collect()}
    assert set(good) == {i for i in whole if scored[i] >= 0.5} and len(good) < len(whole)
    kept = original.where(F.col("doc_id").isin(list(good)))
    parts = {r.doc_id: r.component_id for r in trie_join.jaccard_components(kept).collect()}
    assert set(distinct) == {i for i, c in parts.items() if i == c}
    leaks = {r.doc_id for r in decontaminate.find_contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(unseen) == set(distinct) - leaks
    assert set(hidden) == set(unseen)
    for i, text in hidden.items():
        base = pii_bootstrap.base_spans(unseen[i])
        assert all(unseen[i][a:b] not in text or k != "email" for k in base for a, b in base[k])
        assert text == unseen[i] or "[" in text
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(hidden) and all(0 < r.length <= 2048 for r in rows)
    run = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)


def test_pipeline_on_edge_rows(spark, tmp_path):
    texts = [None, "", "a b c d e f", "a b c d e f", "x" * 100_000, "mail me at a.b@example.com now please", "word " * 5000]
    rows = [(i, t, None, None, None, "clash") for i, t in enumerate(texts)] + [(None, "null id here", "en", "s", 1, "clash")]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (2, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() > 0
