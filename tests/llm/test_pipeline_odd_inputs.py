"""The pipeline on tables without documents, without texts, and with columns that stages name themselves."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, uid string, kept string, row string, entropy string, component_id string"
GOOD = "the old river runs past green fields and under cold skies where grey stones lie beside slow water until evening comes"


@pytest.mark.parametrize("kind", ["empty", "null", "clash"])
def test_pipeline_keeps_its_columns_and_defined_results(spark, tmp_path, kind):
    import corpus_pipeline

    extra = ("en", "s", None, "a", "b", "c", "d", "e", "f")
    rows = {"empty": [], "null": [(1, None, *extra), (None, None, *extra)], "clash": [(k, f"{GOOD} number {k} {'and so on ' if k % 2 else ''}", *extra) for k in range(30)] + [(90, "", *extra), (91, "x " * 5000, *extra)]}[kind]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    if kind == "clash":
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns
        kept = at.collect()
        assert kept and all((r.score, r.uid, r.kept, r.row, r.entropy, r.component_id) == ("a", "b", "c", "d", "e", "f") for r in kept) and not {90, 91} & {r.doc_id for r in kept}
    else:
        packed = corpus_pipeline.run(spark, str(tmp_path))
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() == 0
