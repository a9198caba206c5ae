"""The pipeline against a plain chain of brute-force stages, given the toxicity machine's own decisions."""

import base64

import public_tokenizers

import corpus_pipeline
from docengine.llm import decontamination, pii, queries, toxicity
from docengine.llm.staging import staged
from tests.llm.test_operators import brute_components


def test_run_equals_a_plain_chain(spark, sf_dir):
    import tiktoken

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.5}
    components = brute_components(sorted(rows.items()), 80)
    rows = {i: t for i, t in rows.items() if components[i][1] == i}
    leaked = {r.doc_id for r in decontamination.leaks(docs, items).collect()}
    rows = {i: t for i, t in rows.items() if i not in leaked}
    masked = {}
    for r in pii.spans(docs).collect():
        if r.doc_id in rows:
            out, at = "", 0
            for s in sorted(r.pii, key=lambda s: (s.start, s.end, s.kind)):
                if s.start >= at:
                    out += r.text[at : s.start] + f"<{s.kind.upper()}>"
                at = max(at, s.end)
            masked[r.doc_id] = out + r.text[at:]
    with open(public_tokenizers.path(queries.BPE_RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(rows) and len(rows) > 100
    for i, t in masked.items():
        assert got[i].text == t and got[i].n_chars == len(t) and got[i].ids == encoding.encode_ordinary(t)


def test_stages_are_the_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, sf_dir))
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())
