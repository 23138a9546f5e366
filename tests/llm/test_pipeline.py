"""The pipeline's stages beside their operators' brute-force versions."""

import hashlib

import public_tokenizers
import sentencepiece
from test_groups import brute_jaccard

import corpus_pipeline
from duelframe.llm import quality, secrets


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, docs
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        kept = spark.createDataFrame(stage(spark, kept, folder).collect(), docs.schema)
        assert kept.columns == columns
        rows = [(r.doc_id, r.text) for r in kept.collect()]
        if k == 0:
            failing = {i for i, t in before.items() if quality.base_fails(quality.measure(t))}
            assert not failing & {i for i, _ in rows} and len(rows) > 0.75 * len(before)
            good = rows
        elif k == 1:
            alike = brute_jaccard(good, 5, 80)
            assert {i for i, _ in rows} == {i for i, (_, c) in alike.items() if i == c}
            single = {i for i, _ in rows}
        elif k == 2:
            assert {i: t for i, t in rows} == {i: secrets.redacted(before[i]) for i in single}
            words = sum(len(t.encode().split()) for _, t in rows)
        else:
            mixed = sum(len(t.encode().split()) for _, t in rows)
            assert words - 25_000 <= mixed <= words
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, hashlib.sha256(",".join(map(str, library.encode(t))).encode()).hexdigest()) for i, t in rows)
    last = corpus_pipeline.STAGES[4][1](spark, kept, folder)
    assert sorted((r.doc_id, r.ids_sha256) for r in last.collect()) == want
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == want
