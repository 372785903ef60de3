"""Stages of the corpus pipeline on their own inputs."""

import corpus_pipeline
from strandline.llm import decontaminate, line_dedup, near_duplicates, toxicity
from strandline.llm.tables import read, settled

SMALL = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_the_one_before_kept(spark):
    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = settled(stage(spark, docs, SMALL), f"test-{name}")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(docs, read(spark, SMALL, "labels")).where("predicted = 1").collect()}
            assert set(after) == set(before) - bad
        elif name == "line_dedup":
            gone = {r.doc_id: set(r.removed) for r in line_dedup.line_report(docs).collect()}
            for k, r in before.items():
                left = "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone[k])
                assert after[k].text == left and after[k].n_chars == len(left)
        elif name == "near_duplicates":
            assert set(after) == {r.doc_id for r in near_duplicates.near_duplicates(docs, 5).where("kept").collect()}
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contamination(docs, read(spark, SMALL, "benchmark")).where("contaminated").collect()}
            assert set(after) == set(before) - bad
        if name != "mixing":
            assert out.columns == columns
        docs = out if name != "mixing" else docs
    assert all(0 < r.taken <= 2 * r.size for r in after.values())


def test_run_and_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert corpus_pipeline.run(spark, SMALL).count() > 0
