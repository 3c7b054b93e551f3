"""The pipeline against its stages by brute force, on a small table."""

import numpy as np

import corpus_pipeline
from tessera.llm import quality_rules
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in quality_rules.assess(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    from test_brute import base_spans, linked

    comp = linked({k: texts[k] for k in kept})
    stay = {k for k in kept if comp[k] == k}
    from tessera.llm import decontaminate

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    index = decontaminate.Index(items).build()
    stay = {k for k in stay if not list(index.found([texts[k]], decontaminate.Limits()))}
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == stay
    clean = [k for k in stay if not base_spans(texts[k])]
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    for k in clean:
        assert tokens[k] == len(t.encode(texts[k], add_special_tokens=False).ids) + 1
    assert len(clean) < len(stay) or not np.any([base_spans(texts[k]) for k in stay])


def test_stage_names():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
