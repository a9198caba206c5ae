"""Fusion, reranking, checks, metrics, logs and stores on small frames."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.operators import encode, fusion, guardrails, metrics, passages, pca, rerank, responses, retrieve, transform
from docengine.plans import run_query as lifecycle
from docengine.sources import filings, querylog, stores
from docengine.streaming import queries as stream

LIST = "query_id string, list_no int, chunk_id string, score double, rank int"


def test_rrf_order_and_ties(spark):
    lists = spark.createDataFrame([("q", 0, "a", 9.0, 1), ("q", 0, "b", 8.0, 2), ("q", 1, "b", 5.0, 1), ("q", 1, "c", 4.0, 2), ("q", 1, "a", 3.0, 3)], LIST)
    got = fusion.rrf(lists).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]
    assert got[0].score == round(1 / 62 + 1 / 61, 6)


def test_convex_edges(spark):
    ranked = lambda rows: spark.createDataFrame([("q", c, float(s), i + 1) for i, (c, s) in enumerate(rows)], "query_id string, chunk_id string, score double, rank int")
    got = {r.chunk_id: r.score for r in fusion.convex(ranked([("a", 2), ("b", 2)]), ranked([("b", 10), ("c", 0)]), 0.7).collect()}
    assert got == {"a": 0.7, "b": 1.0, "c": 0.0}
    empty = ranked([("x", 1)]).where("false")
    assert {r.chunk_id: r.score for r in fusion.convex(empty, ranked([("b", 10), ("c", 0)]), 0.7).collect()} == {"b": 0.3, "c": 0.0}


def test_listwise_rerank(spark):
    cand = spark.createDataFrame([("q", "t", f"c{i}", "x", 1.0 - i / 10, i) for i in range(1, 5)] + [("r", "t", "z", "x", 0.5, 1)], "query_id string, query string, chunk_id string, content string, score double, rank int")
    said = spark.createDataFrame([("q", '```json\n{"ranking": [4, "2", 4, 77, "no"]}\n```'), ("r", "not json")], "query_id string, response string")
    got = rerank.listwise(cand, said, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in got] == [("q", "c4", 1.0), ("q", "c2", 0.5), ("q", "c1", 0.333333), ("r", "z", 0.5)]
    with pytest.raises(ValueError):
        rerank.rerank(cand, "nope", 3)


def test_late_interaction(spark):
    q = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0])], "query_id string, token_no int, vector array<double>")
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("b", [0.0, 1.0])], "chunk_id string, vector array<double>")
    cand = spark.createDataFrame([("q", "t", "a", "x", 9.0, 1), ("q", "t", "b", "x", 1.0, 2)], "query_id string, query string, chunk_id string, content string, score double, rank int")
    got = rerank.late_interaction(q, c, cand, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("b", 1.6), ("a", 1.0)]


def report(spark, module, query, answer, top):
    kind = "module string, query string, answer string, top array<struct<score:double,content:string,doc_id:string,effective_date:string,filing_date:string>>"
    return guardrails.check(spark.createDataFrame([(module, query, answer, top)], kind), F.lit("2024-06-01").cast("date")).first()


def passage(score, content, doc="d", effective=None, filing=None):
    return (score, content, doc, effective, filing)


def test_guardrails(spark):
    r = report(spark, "credit", "What is the current revenue?", "Revenue was $1,200 million in 2023. The moon consists of green cheese entirely.", [passage(1.2, "Revenue was 1200 million during fiscal 2023 for the company", "a", "2019-01-01"), passage(0.5, "x", "b", "2018/02/03"), passage(0.4, "y", "b", "2018/02/03"), passage(0.1, "z", "c", "bad date", "2000-01-01")])
    assert r.confidence == pytest.approx(0.8) and r.confidence_label == "high"
    assert r.citation_coverage == 0.5 and len(r.unsupported_sentences) == 1
    assert r.grounded_numbers == 2 and r.ungrounded_numbers == []
    assert [w.code for w in r.warnings] == ["low_citation_coverage", "stale_source", "stale_source", "stale_source", "temporal_mismatch"]
    r = report(spark, "compliance", "anything", None, [])
    assert (r.confidence, r.confidence_label, r.citation_coverage, [w.code for w in r.warnings]) == (0.0, "low", None, ["low_retrieval_confidence"])
    r = report(spark, "credit", "x", "It grew 45% to $7.5 billion.", [passage(30.0, "It grew slowly")])
    assert r.confidence == 1.0 and r.ungrounded_numbers == ["45%", "$7.5 billion"]


def test_content_words_against_python(spark):
    import re

    texts = ["The étoffe abc-def and X9 would be a-b 12ab aa", "", "don't stop-believing NOW 3d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", guardrails.content_words(F.col("t")).alias("w"))
    for row in df.collect():
        assert set(row.w) == {w for w in re.findall(r"\b[a-z][a-z0-9-]+\b", row.t.lower()) if len(w) >= 3 and w not in guardrails.STOP_WORDS}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", i + 1, r) for i, r in enumerate([0, 1, 0, 1])] + [("z", 1, 0)], "query_id string, rank int, relevance int")
    got = {r.query_id: r for r in metrics.per_query(ranked).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got["q"].ndcg == round((1 / math.log2(3) + 1 / math.log2(5)) / ideal, 6)
    assert (got["q"].mrr, got["q"].ap, got["q"].recall_1, got["q"].recall_3) == (0.5, 0.5, 0.0, 1.0)
    assert (got["z"].ndcg, got["z"].mrr, got["z"].ap) == (0, 0, 0)
    best = metrics.best(spark.createDataFrame([(0, 0.5), (1, None), (2, 0.5)], "config_no int, ndcg double"), "ndcg").first()
    assert best.config_no == 0
    row = spark.createDataFrame([(["Cap", "ratio"], "the CAP is high")], "c array<string>, a string").select(metrics.concept_coverage(F.col("c"), F.col("a")).alias("x")).first()
    assert row.x == 0.5


def test_components(spark):
    x = np.random.default_rng(0).normal(size=(300, 6)) * [5, 3, 1, 0.5, 0.2, 0.1]
    df = spark.createDataFrame([(row.tolist(),) for row in x], "embedding array<double>").repartition(4)
    model, whole = pca.fit(df, dims=(2, 4, 6))
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(whole.eigenvalues, values) and whole.elbow_95pct == int(np.searchsorted(np.cumsum(values / values.sum()), 0.95)) + 1
    projected = np.array([r.projected for r in pca.project(df, model, 2).collect()])
    assert np.allclose(np.linalg.norm(projected, axis=1), 1)
    assert pca.snapped(3, (2, 4, 6)) == 2
    with pytest.raises(ValueError):
        pca.fit(df.limit(1))


def test_transforms_and_responses(spark):
    q = spark.createDataFrame([("1", "what is it"), ("2", "other")], "query_id string, query string")
    asked = transform.prompt("hyde", F.col("query"), "credit")
    said = q.limit(1).select(responses.key_of(asked).alias("key"), F.lit("a passage").alias("response"))
    got = {r.query_id: r.query for r in transform.hyde(q, "credit", said).collect()}
    assert got == {"1": "a passage", "2": "other"}
    with pytest.raises(ValueError):
        transform.apply("prf", q, "credit")
    with pytest.raises(ValueError):
        transform.apply("nope", q, "credit")
    followed = transform.rewrite_followups(q.withColumn("history", F.lit(None).cast("string")), None)
    assert [r.rewritten for r in followed.orderBy("query_id").collect()] == ["what is it", "other"]


def test_retrieval_edges(spark):
    chunks = spark.createDataFrame([("a", "alpha beta beta", "x"), ("b", "beta gamma", "y"), ("c", None, "x")], "chunk_id string, content string, kind string")
    q = spark.createDataFrame([("1", "beta"), ("2", "  "), ("3", "nothing")], "query_id string, query string")
    assert {(r.query_id, r.chunk_id) for r in retrieve.sparse(q, chunks, 5).collect()} == {("1", "a"), ("1", "b")}
    assert [r.chunk_id for r in retrieve.search(q, chunks, "sparse", filters={"kind": ["y"]}).collect()] == ["b"]
    for bad in (lambda: retrieve.search(q, chunks, "nope"), lambda: retrieve.sparse(q, chunks, 1, "nope"), lambda: retrieve.by_method("nope", q, chunks)):
        with pytest.raises(ValueError):
            bad()


def test_dense_plan_broadcasts_queries_and_prunes(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding")._jdf.queryExecution().toString()
    assert "label" not in plan.split("ReadSchema")[-1]


def test_stores_and_log(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    assert stores.load(spark, path, rows) == "loaded" and stores.load(spark, path, rows) == "skipped"
    stores.upsert(spark, path, spark.createDataFrame([("b", 5), ("c", 6)], "chunk_id string, v int"))
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 5), ("c", 6)}
    assert stores.ensure(spark, path, rows.schema) == "skipped" and stores.ensure(spark, path, rows.schema, recreate=True) == "recreated"
    log = tmp_path / "log"
    log.mkdir()
    (log / "x.json").write_text(json.dumps({"query_id": "1", "timestamp_utc": "2024", "query": "q"}) + "\n{broken\n")
    assert [r.query_id for r in querylog.tail(spark, f"file://{log}").collect()] == ["1"]


def test_stream_of_queries(spark, tmp_path):
    chunks = encode.embed(spark.createDataFrame([("a", "d1", "alpha beta"), ("b", "d2", "gamma delta")], "chunk_id string, doc_id string, content string"), "content")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"query_id": "1", "query": "alpha"}\n')
    (folder / "2.json").write_text('{"query_id": "2", "query": "gamma"}\n{"query_id": "3", "query": " "}\n')
    log = f"file://{tmp_path}/log"
    run = stream.serve(stream.incoming(spark, f"file://{folder}"), chunks, lifecycle.Config(method="bm25"), log, f"file://{tmp_path}/cp")
    run.awaitTermination()
    assert sorted((r.query_id, r.top_chunks[0].chunk_id) for r in querylog.tail(spark, log).collect()) == [("1", "a"), ("2", "b")]


def test_filings(spark):
    good = spark.createDataFrame([("2023-07-01",), ("bad",), ("2023-x-1",), ("",)], "d string")
    got = [tuple(r) for r in good.select(*filings.fiscal_period(F.col("d"))).collect()]
    assert got == [(2023, 3), (None, None), (None, None), (None, None)]


def test_passages(spark):
    text = " ".join(f"Sentence number {i} has quite a few ordinary words in it for counting." for i in range(80))
    docs = spark.createDataFrame([("d", "t", text, None, None), ("e", "t", "Too. Short.", None, None)], "doc_id string, doc_type string, full_text string, sections array<struct<heading:string,section_number:string,char_start:int,char_end:int>>, pages array<struct<page_number:int,char_start:int,char_end:int>>")
    got = passages.candidates(docs).orderBy("char_start").collect()
    assert got and all(150 <= r.n_tokens <= 400 and text[r.char_start : r.char_end].strip() == r.passage_text for r in got)
    starts = [r.first_sentence for r in got]
    assert starts[0] == 0 and all(b - a >= 8 for a, b in zip(starts, starts[1:]))


def test_component_models_and_unions(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(120, 4))
    df = spark.createDataFrame([(row.tolist(),) for row in x], "embedding array<double>")
    model, _ = pca.fit(pca.union([df.limit(60), df.limit(60)]), dims=(2, 4))
    model.save(spark, f"file://{tmp_path}/model")
    again = pca.Model.load(spark, f"file://{tmp_path}/model")
    assert np.allclose(model.mean, again.mean) and np.allclose(model.components, again.components)
    with pytest.raises(ValueError):
        pca.union([df.limit(5)])


def test_ablation_and_loads(spark, tmp_path):
    from docengine.plans import sweeps

    texts = ["alpha beta gamma delta", "beta beta epsilon", "zeta eta theta", "alpha zeta iota kappa"]
    chunks = encode.embed(spark.createDataFrame([(f"c{i}", f"d{i}", t, 0, len(t), "compliance", "semantic") for i, t in enumerate(texts)], "chunk_id string, doc_id string, content string, char_start int, char_end int, module string, chunk_strategy string"), "content")
    q = encode.embed(spark.createDataFrame([("1", "alpha gamma"), ("2", "theta")], "query_id string, query string"), "query")
    sources = spark.createDataFrame([("1", "d0", 0, 20), ("2", "d2", 0, 14)], "query_id string, source_doc_id string, char_start int, char_end int")
    rows = sweeps.ablation(spark, q, chunks, sources, methods=("bm25", "nope"), transforms=("none",), rerankers=("none", "cross_encoder"), k=3).orderBy("config_no").collect()
    assert [(r.stage, r.method, r.reranker) for r in rows] == [(1, "bm25", "none"), (1, "nope", "none"), (2, "bm25", "none"), (3, "bm25", "none"), (3, "bm25", "cross_encoder")]
    assert rows[0].ndcg == 1.0 and rows[1].ndcg is None and "nope" in rows[1].error
    done = stores.load_all(spark, f"file://{tmp_path}", chunks)
    assert done["compliance_semantic"] == "loaded" and len(done) == 6


def test_cells_find_most_of_the_exact_neighbours(spark):
    from docengine.operators import cells

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    copies = e.where("chunk_id < 3").crossJoin(spark.range(300)).select((F.col("chunk_id") + 10**6 + 3 * F.col("id")).alias("chunk_id"), "embedding")  # a cell of copies
    chunks = e.unionAll(copies)
    q = e.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    c = cells.centroids(chunks)
    index, exact = cells.index(chunks, c), retrieve.dense(q, chunks, 10)
    assert index.count() == chunks.count()
    assert cells.recall(cells.search(q, index, c, 10), exact) >= 0.9
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(cells.search(q, index, c, 10, probes=len(c))) == rows(exact)
    assert cells.search(q, index.where("false"), c, 10).count() == 0 and len(cells.centroids(chunks.where("false"))) == 0


def test_hashing_embedder_equals_a_plain_loop():
    import hashlib
    import re

    texts = ["Alpha beta alpha", "", None, "éß 12 _x", "beta"]
    want = np.zeros((len(texts), 64))
    for row, t in zip(want, texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            row[int.from_bytes(h[:4], "little") % 64] += 1 if h[4] & 1 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert np.allclose(encode.hashing_embedder(texts), want, atol=1e-6)
    assert encode.hashing_embedder([]).shape == (0, 64)


def test_moments_merge_in_a_tree(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(90, 3)) + 4
    df = spark.createDataFrame([(row.tolist(),) for row in x], "embedding array<double>").repartition(9)
    monkeypatch.setattr(pca, "FAN", 2)
    n, mean, scatter = pca.moments(df)
    assert n == 90 and np.allclose(mean, x.mean(0)) and np.allclose(scatter / 89, np.cov(x.T))
    assert pca.moments(df.where("false"))[0] == 0


def test_upserts_that_broke_off_are_finished(spark, tmp_path):
    path = f"file://{tmp_path}/points"
    rows = lambda *r: spark.createDataFrame(r, "chunk_id string, v int")
    stores.upsert(spark, path, rows(("a", 1), ("a", 2)))
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", 2)]  # the last by columns, on the first load too
    stores.merged(spark.read.parquet(path), rows(("b", 3)), "chunk_id").write.parquet(path + ".next")
    (tmp_path / "points").rename(tmp_path / "points.old")  # broken off between the renames
    stores.upsert(spark, path, rows(("c", 4)))
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 3), ("c", 4)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["points"]
    with pytest.raises(Exception, match="more than 1 rows"):
        stores.json_array(rows(("a", 1), ("b", 2)), "chunk_id", most=1).collect()


@pytest.mark.parametrize("name", ["none", "cross_encoder", "monot5", "colbert", "rankgpt"])
def test_every_reranker_in_the_lifecycle(spark, name):
    chunks = encode.embed(spark.createDataFrame([("a", "d1", "alpha beta"), ("b", "d2", "alpha gamma delta alpha"), ("c", "d3", "alpha")], "chunk_id string, doc_id string, content string"), "content")
    q = spark.createDataFrame([("1", "alpha gamma"), ("2", " ")], "query_id string, query string")
    found = retrieve.sparse(q, chunks, 10).join(chunks, "chunk_id").join(q, "query_id")
    said = rerank.listwise_prompt(found.withColumn("content", F.col("content"))).select(responses.key_of(F.col("prompt")).alias("key"), F.lit("[3, 1]").alias("response"))
    got = lifecycle.run(q, chunks, lifecycle.Config(reranker=name, final_k=3), said).collect()
    assert [r.query_id for r in got] == ["1"]
    order = [c.chunk_id for c in got[0].top]
    assert sorted(order) == ["a", "b", "c"] and (order[0] == "b" or name == "rankgpt")
    if name == "rankgpt":
        plain = [r.chunk_id for r in found.orderBy("rank").collect()]
        assert order == [plain[2], plain[0], plain[1]]


def test_stage_times_and_their_line(spark):
    chunks = encode.embed(spark.createDataFrame([("a", "d1", "alpha beta")], "chunk_id string, doc_id string, content string"), "content")
    rows, took = lifecycle.timed(spark.createDataFrame([("1", "alpha")], "query_id string, query string"), chunks, lifecycle.Config())
    assert len(rows) == 1 and set(took) == {"retrieve", "transform", "rerank", "generate", "total"} and took["total"] > 0
    results = lifecycle.run(spark.createDataFrame([("1", "alpha")], "query_id string, query string"), chunks, lifecycle.Config())
    assert lifecycle.log_rows(results, lifecycle.Config(), took).first().timings["total"] == took["total"]


def test_lost_turns_and_other_roles(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 1, "user", "a"), (1, 2, "system", "x"), (1, 3, "assistant", "c"), (2, 0, "system", "y"), (3, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.history for r in transform.history_text(turns).collect()}
    assert got == {1: "USER: b\nUSER: a\nASSISTANT: c", 2: "(none)", 3: "(none)"}


def test_blank_dense_queries_find_nothing(spark):
    q = spark.createDataFrame([("1", " ", [1.0, 0.0]), ("2", "x", [1.0, 0.0])], "query_id string, query string, embedding array<double>")
    c = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, embedding array<double>")
    assert [r.query_id for r in retrieve.dense(q, c, 5).collect()] == ["2"]


def test_candidates_equal_a_plain_loop(spark):
    """Windows, one by one."""
    import random
    import re

    import regex

    rng = random.Random(3)
    word = lambda: rng.choice(("alpha", "beta", "the", "of", "gamma", "1,000", "see"))
    tail = lambda: rng.choice(("", "", " as discussed above", "; (x)"))
    texts = [" ".join(f"{rng.choice(('The', 'A', 'so', 'Item'))} " + " ".join(word() for _ in range(rng.randint(3, 60))) + tail() + rng.choice((".", "!", "?")) for _ in range(rng.randint(2, 70))) for _ in range(12)]
    docs = spark.createDataFrame([(i, "t", t, None, None) for i, t in enumerate(texts)], "doc_id long, doc_type string, full_text string, sections array<struct<heading:string,section_number:string,char_start:int,char_end:int>>, pages array<struct<page_number:int,char_start:int,char_end:int>>")
    tokens = lambda t: len(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", t))

    def contained(t):
        t = t.strip()
        opens = t[:1].isupper() or t[:1] in passages.OPENING
        return len(t) >= 50 and opens and not re.search(passages.BOILERPLATE, t) and not re.search(passages.ELSEWHERE, t) and sum(c.isalpha() for c in t) / len(t) >= 0.5

    want = set()
    for d, t in enumerate(texts):
        cuts = [0, *(x for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z\"'(])", t) for x in m.span()), len(t)]
        s = list(zip(cuts[::2], cuts[1::2]))
        n = [tokens(t[a:b]) for a, b in s]
        last, following = -(10**9), 0
        if len(s) < 4:
            continue
        for i in range(len(s)):
            if i < following or i - last < passages.APART:
                continue
            j, total = i, 0
            while j < len(s) and total < passages.TARGET:
                total += n[j]
                j += 1
            a, b = s[i][0], s[j - 1][1]
            if passages.LEAST <= total <= passages.MOST and contained(t[a:b]):
                want.add((d, i, a, b, total))
                last, following = i, j
    got = {(r.doc_id, r.first_sentence, r.char_start, r.char_end, r.n_tokens) for r in passages.candidates(docs).collect()}
    assert got == want and len(want) > 5
