import collections

import corpus_pipeline
from cloneframe.llm.frames import written

from .cases import documents
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            counts.append(out.count())
            docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    assert not [r for r in docs.collect() if "AKIA" in r["text"]]
    rows = out.collect()
    check_packing(rows, 4096)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_run_keeps_no_copies(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    starts = collections.Counter((r["ids_crc32"], r["length"]) for r in rows if r["piece"] == 0)
    assert max(starts.values()) == 1


def test_each_stage_takes_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, further columns with clashing names; then empty tables."""
    df = documents(spark)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(3, 11)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, df, str(tmp_path)))
        if name == "best_fit_packing":
            check_packing(out.collect(), 4096)
            assert out.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
        else:
            assert out.columns == corpus_pipeline.COLUMNS
            assert out.select("doc_id").exceptAll(df.select("doc_id")).count() == 0
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert {tuple(r) for r in corpus_pipeline.redact(spark, df, "").filter("doc_id is null").collect()} == {(None, "one two", None, None, 7)}
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(run, 4096)
