import corpus_pipeline
from conftest import write


def test_stages(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count(), name
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert len([1 for i, t in rows if i in ids]) < len(rows)


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_decisions(spark, tmp_path):
    import random

    from conftest import prose

    rng = random.Random(11)
    base, passage, item = prose(rng, 150), prose(rng, 70), prose(rng, 30)
    near = base.split()
    near[70] = "other"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 80)), (5, prose(rng, 90) + "\n" + passage + "\n" + prose(rng, 60)), (6, prose(rng, 100) + " " + item + " " + prose(rng, 200)), (7, prose(rng, 120)), (8, None)]
    sf = write(tmp_path / "p", rows, [], [(1, item)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id for r in stages["minhash_near_dedup"](spark, docs, sf).collect()) == [1, 4, 5, 6, 7, 8]
    cut = {r.doc_id: r.text for r in stages["suffix_array_dedup"](spark, docs.where("doc_id > 3"), sf).collect()}
    assert all(passage not in cut[i] for i in (4, 5)) and cut[7] == rows[6][1] and cut[8] is None
    assert sorted(r.doc_id for r in stages["benchmark_decontamination"](spark, docs, sf).collect()) == [1, 2, 3, 4, 5, 7, 8]
