import corpus_pipeline
from twinframe.llm import pii
from twinframe.llm.common import stage_table

from .helpers import DOCS, frame
from .test_decontamination import BENCH, plain as hits, tables
from .test_near_copies import plain_kept
from .test_quality_rules import plain as counts


def folder(spark, tmp_path, docs, items):
    frame_ = docs if hasattr(docs, "columns") else frame(spark, docs)
    frame_.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = tables()
    rows.append((700, "write to someone@mail.example.com or 10.1.2.3 " * 1 + " ".join(f"w{i}" for i in range(30)), "en", "s", 1))
    top = folder(spark, tmp_path, rows, items)
    docs, results = spark.read.parquet(f"{top}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage_table(stage(spark, docs, top), "t")
        assert docs.columns == [f.name for f in DOCS], name
        results.append({r.doc_id: r.text for r in docs.collect()})
    good = [r for r in rows if counts(r[1])[0] >= 20 and 100 * counts(r[1])[4] <= 30 * counts(r[1])[0]]
    assert results[0] == {i: t for i, t, *_ in good}
    assert sorted(results[1]) == plain_kept(good)
    assert set(results[2]) == set(results[1]) and not any(hits(t, items)[1] for t in results[2].values())
    assert results[3] == {i: pii.mask(t, pii.find_spans(t)) for i, t in results[2].items()}
    packed = corpus_pipeline.run(spark, top).collect()
    assert {r.doc_id for r in packed} == set(results[3])


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, spark.createDataFrame([], DOCS), [])).collect() == []
