"""Each stage of the pipeline against brute force on the stage's own input."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from hearthline.llm import byte_bpe, decontamination, toxicity

from .test_text_operators import links_by_force


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near copies", "decontamination", "byte-level BPE"]

    ordinary = corpus_pipeline.materialise(stage["toxicity"](spark, docs, folder))
    assert ordinary.schema.names == docs.schema.names
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scorer = toxicity.fit_scorer(docs, labels)
    get = toxicity.Evidence(scorer.models)
    texts = docs.select("doc_id", "text").toArrow()
    scores = scorer.scores(texts.column("text").combine_chunks(), get)
    want = {k for k, s in zip(texts.column("doc_id").to_pylist(), scores, strict=True) if s < 0.3}
    assert set(rows_of(ordinary)) == want and len(want) > 100

    distinct = corpus_pipeline.materialise(stage["near copies"](spark, ordinary, folder))
    assert distinct.schema.names == docs.schema.names
    links = links_by_force({k: r["text"] for k, r in rows_of(ordinary).items()}, 5, 80)
    assert set(rows_of(distinct)) == {k for k, v in links.items() if v[2]}

    clean = corpus_pipeline.materialise(stage["decontamination"](spark, distinct, folder))
    assert clean.schema.names == docs.schema.names
    items = [decontamination.normal(r["text"].encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def holds(text):
        text = decontamination.normal(text.encode())
        return any(decontamination.Myers(i).best(text)[0] <= decontamination.edits_allowed(len(i)) for i in items if len(i) >= decontamination.LEAST)

    short = {k: r["text"] for k, r in rows_of(distinct).items() if len(r["text"]) < 4000}
    kept = set(rows_of(clean))
    assert {k for k in short if k in kept} == {k for k, t in short.items() if not holds(t)}

    coded = rows_of(stage["byte-level BPE"](spark, clean, folder))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert set(coded) == kept
    for k, r in rows_of(clean).items():
        assert coded[k]["ids"] == encoding.encode_ordinary(r["text"]) and coded[k]["round_trip"] and coded[k]["n_tokens"] == len(coded[k]["ids"])
