"""The stages of the pipeline over a small corpus, and that no clean document is lost."""

import corpus_pipeline

from tests.llm.test_operators import text_of


def test_stages(spark, tmp_path):
    clean = [(i, text_of(100 + i, 80), "en", "src", 0) for i in range(12)]
    rows = clean + [
        (20, clean[0][1], "en", "src", 0), (21, text_of(1, 10), "en", "src", 0), (22, "so so so " * 40, "en", "src", 0), (23, None, None, None, None),
        (24, text_of(200, 60) + " " + text_of(103, 80) + " " + text_of(201, 60), "en", "src", 0),
        (25, text_of(300, 60) + " password=abcdef99", "en", "src", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in (*range(12), 20, 24, 25)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    folder, now, seen = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
    assert set(range(12)) <= set(seen["best_fit_packing"])
    assert set(seen["quality_rules"]) == {*range(12), 20, 24, 25}
    assert set(seen["simhash_near_dedup"]) == {*range(12), 24, 25}
    cut = seen["substring_dedup"][24]
    assert text_of(200, 60) in cut["text"] and text_of(103, 80) not in cut["text"] and cut["n_chars"] == len(cut["text"])
    assert seen["secret_scans"][25]["text"].endswith("[SECRET]")
    assert corpus_pipeline.run(spark, folder).count() == len(seen["best_fit_packing"])
