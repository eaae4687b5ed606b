from test_substring import brute

import corpus_pipeline
from corpuslake.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "repeats", "mix", "pack"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF), name))
        if name != "pack":
            assert seen[-1].columns == docs.columns
    start, language, near, cut, mix, pack = (d.collect() for d in seen)
    assert {r.doc_id for r in language} == {r.doc_id for r in start}  # nothing here is foreign
    assert len({r.doc_id for r in near}) == len(near) and len({r.text for r in near}) == len(near) < len(start)
    want = {r.doc_id: b for r, b in zip(near, brute([r.text for r in near], 35))}
    assert {r.doc_id: r.text for r in cut} == {r.doc_id: want[r.doc_id][2] if want[r.doc_id][1] else r.text for r in near}
    assert all(r.n_chars == len(r.text) for r in mix)
    words = sum(len(r.text.split()) for r in cut)
    assert abs(sum(len(r.text.split()) for r in mix) - 1.5 * words) < 0.01 * words + 20
    assert len({r.doc_id for r in pack}) == len({r.doc_id for r in mix})


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), name)
        docs.count()
