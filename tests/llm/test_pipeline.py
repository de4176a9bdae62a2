"""The pipeline against the operators' own verdicts, stage by stage."""

import re

import numpy as np

import corpus_pipeline
from kgspark.llm.byte_bpe import byte_bpe
from tests.llm.test_dedup import brute_components, brute_cut
from tests.llm.test_text_models import check_pieces


def test_pipeline_against_brute_force(spark, folder, documents):
    from kgspark.llm.quality_rules import judged

    kept = {r["doc_id"] for r in judged(documents).collect() if r["kept"]}
    rows = {r["doc_id"]: r["text"] for r in documents.collect() if r["doc_id"] in kept}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: rows[i] for i in last.values()}
    comp = brute_components(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if comp[i] == i}
    cut = {int(i): (removed, left) for i, _, removed, left in brute_cut(list(rows.items()))}
    rows = {i: cut[i][1] if cut[i][0] else t for i, t in rows.items()}
    ids = {i: np.append(byte_bpe().encode(t), 1) for i, t in rows.items()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(rows)
    check_pieces(got, ids, 2048)


def test_stages_keep_columns(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns, name
        assert stage(spark, none, "").count() == 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, "")
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert pieces.where("start = 0").count() == odd.count() and corpus_pipeline.STAGES[-1][1](spark, none, "").columns == pieces.columns
    assert [re.sub(r"_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "substring", "packing"]
