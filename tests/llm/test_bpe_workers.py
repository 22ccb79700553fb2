"""The Python workers of byte-level BPE: one a task in the pipeline, and the same ids whatever they remember."""

import corpus_pipeline
from reldrift.llm import bpe


def test_pipeline_decodes_written_ids(spark):
    texts = ["one two  two", None, "", "naïve \U0001f600\n" * 50]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, source string, n_chars long")
    done = corpus_pipeline.tokenize(spark, docs, "")
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = sorted(done.collect(), key=lambda r: r.doc_id)
    assert all(r.round_trip for r in rows) and [r.n_tokens > 0 for r in rows] == [True, False, False, True, True]
    assert rows[0].token_ids == rows[4].token_ids


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    codec = bpe.Codec(bpe.default_path(), bpe.default_pattern())
    texts = [" ".join(f"word{i * j} über{i}" for j in range(40)) for i in range(30)]
    whole = [i.tolist() for i in codec.encode_batch(texts)]
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 50)
    codec.forget()
    assert [codec.encode_batch([t])[0].tolist() for t in texts] == whole
