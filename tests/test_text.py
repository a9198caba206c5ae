"""Spans, sections and chunks against plain Python on small documents."""

import re

import numpy as np
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.functions import spans as S
from docengine.functions import text as X
from docengine.operators import chunking
from docengine.plans.fixtures import EMPTY_PAGES
from docengine.schema import SECTION, TABLE
from docengine.sources import html, sections

TEXT = 'Été is here. "Quoted," he said! (Yes.) No 😀 more?\n\n  Next para.  \n \n[Bracket] Item. X'


def plain_spans(text, boundary):
    out, at = [], 0
    for m in [*re.finditer(boundary, text), None]:
        end = m.start() if m else len(text)
        piece = text[at:end]
        if piece.strip():
            out.append((piece.strip(), at + len(piece) - len(piece.lstrip()), end))
        at = m.end() if m else end
    return out


def tokens(text):
    return len(regex.findall(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", text))


def plain_pack(units, least, most):
    out, cur = [], None
    for text, start, end in units:
        n = tokens(text)
        if n >= most:
            out += [cur] if cur else []
            out.append((text, start, end, n))
            cur = None
        elif cur and cur[3] + n > most and cur[3] >= least:
            out.append(cur)
            cur = (text, start, end, n)
        else:
            cur = (f"{cur[0]}\n\n{text}", cur[1], end, cur[3] + n) if cur else (text, start, end, n)
    return out + ([cur] if cur else [])


def spans_of(spark, text, f):
    df = spark.createDataFrame([(text,)], "t string")
    return [tuple(s)[:3] for s in df.select(f(F.col("t")).alias("s")).first().s]


def test_sentences_and_paragraphs(spark):
    for text in (TEXT, "", "   ", "One.", "A. B. C. ", "a😀. B"):
        assert spans_of(spark, text, X.sentence_spans) == plain_spans(text, r"(?<=[.!?])\s+(?=[A-Z\"'(\[])")
        assert spans_of(spark, text, X.paragraph_spans) == plain_spans(text, r"\n\s*\n")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aB.! \né😀", max_size=60), min_size=1, max_size=20))
def test_spans_of_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.sentence_spans(F.col("t")).alias("s"), X.paragraph_spans(F.col("t")).alias("p"))
    for row in df.collect():
        assert [tuple(s) for s in row.s] == plain_spans(row.t, r"(?<=[.!?])\s+(?=[A-Z\"'(\[])")
        assert [tuple(s) for s in row.p] == plain_spans(row.t, r"\n\s*\n")


def test_pack_by_hand(spark):
    units = [("w " * n).strip() for n in (60, 70, 500, 700, 10)]
    df = spark.createDataFrame([([{"text": u, "char_start": 10 * i, "char_end": 10 * i + 9} for i, u in enumerate(units)],)], "u array<struct<text:string,char_start:int,char_end:int>>")
    got = df.select(chunking.pack(X.counted(F.col("u")), 100, 600).alias("c")).first().c
    assert [(c.char_start, c.char_end, c.content_tokens) for c in got] == [(0, 19, 130), (20, 29, 500), (30, 39, 700), (40, 49, 10)]


def test_uuid5(spark):
    import uuid

    got = spark.createDataFrame([("é|s|0",)], "n string").select(X.uuid5(F.col("n")).alias("u")).first().u
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "é|s|0"))


SECTIONED = "Item 1. Business overview\nText a.\n\nArticle 5 — Scope of it\n1.2 Title here\nsome words\n\n\nChapter IV: Last one\nItem 7A. Risks and more\nEnd"


def test_sections_agree_with_the_python_form(spark):
    for text in (SECTIONED, "", "nothing here", "\n\n  Item 2. Properties of it\nx"):
        row = spark.createDataFrame([(text,)], "t string").select(sections.detect_sections(F.col("t")).alias("s")).first()
        assert [s.asDict() for s in row.s] == [{k: s[k] for k in ("heading", "level", "section_number", "char_start", "char_end")} for s in html.sections_of(text)]


def doc(spark, text, secs, tabs=()):
    rows = [("d", "T", "k", {"jurisdiction": "CA", "fiscal_year": "2020"}, text, [], secs, [dict(t, n_rows=1, n_cols=1) for t in tabs])]
    return spark.createDataFrame(rows, f"doc_id string, doc_title string, doc_type string, metadata map<string,string>, full_text string, pages {EMPTY_PAGES}, sections array<{SECTION}>, tables array<{TABLE}>")


def sec(heading, level, number, a, b):
    return {"heading": heading, "level": level, "section_number": number, "char_start": a, "char_end": b}


def long_text(n, seed):
    return "\n\n".join(f"Par {seed} {i} " + "word " * (i * 37 % 90) for i in range(n))


def rows_of(df, *cols):
    return [tuple(r) for r in df.orderBy("chunk_index").select(*cols).collect()]


def test_regulatory_and_hierarchical(spark):
    a, b, c = "Head A\n" + long_text(4, 1), "\nSub B\n" + long_text(40, 2), "  \n "
    d = "\nHead D\nshort"
    text = a + b + c + d
    at = [0, len(a), len(a + b), len(a + b + c), len(text)]
    secs = [sec("Head A", 1, "1", at[0], at[1]), sec("Sub B", 2, "1.1", at[1], at[2]), sec("Blank", 2, "1.2", at[2], at[3]), sec("Head D", 1, "2", at[3], at[4])]
    df = doc(spark, text, secs)
    want = []
    for s in secs:
        raw = text[s["char_start"] : s["char_end"]]
        if raw.strip():
            n = tokens(raw.strip())
            parts = [(raw.strip(), s["char_start"], s["char_end"], n)] if n <= 600 else plain_pack([(t, x + s["char_start"], y + s["char_start"]) for t, x, y in plain_spans(raw, r"\n\s*\n")], 100, 600)
            want += [(*p, s["heading"]) for p in parts]
    got = chunking.chunk_documents(df, "compliance", "regulatory_boundary")
    assert rows_of(got, "content", "char_start", "char_end", "content_tokens", "section_title") == want
    assert got.first().fiscal_year == 2020 and got.first().jurisdiction == "CA" and got.first().naics_code == ""

    want = []
    for k, (p, end) in enumerate(((secs[0], at[3]), (secs[3], at[4]))):
        whole = text[p["char_start"] : end].strip()
        n = tokens(whole)
        if n > 1200:
            whole = whole[: int(len(whole) * (1200 / n))] + "\n[...truncated for parent context]"
        want.append((whole, p["char_start"], end, tokens(whole), "parent", p["heading"], None))
        parent = len(want) - 1
        for s in secs[1:3] if k == 0 else []:
            own = text[s["char_start"] : s["char_end"]].strip()
            if own:
                n = tokens(own)
                parts = [(own, s["char_start"], s["char_end"], n)] if n <= 350 else plain_pack([(t, x + s["char_start"], y + s["char_start"]) for t, x, y in plain_spans(own, r"\n\s*\n")], 100, 350)
                want += [(*q, "child", f"{p['heading']} > {s['heading']}", parent) for q in parts]
    got = chunking.chunk_documents(df, "compliance", "hierarchical").orderBy("chunk_index").collect()
    ids = [r.chunk_id for r in got]
    assert [(r.content, r.char_start, r.char_end, r.content_tokens, r.chunk_level, r.hierarchy_path, ids.index(r.parent_chunk_id) if r.parent_chunk_id else None) for r in got] == want


def test_financial_and_narrative(spark):
    body = [long_text(9, 1), "| a | b |", long_text(30, 2), "| c |", "Tail words here."]
    text = "\n".join(body)
    starts = [text.index(b) for b in body]
    tabs = [{"markdown": body[i], "char_start": starts[i], "char_end": starts[i] + len(body[i])} for i in (1, 3)]
    secs = [sec("Consolidated Balance Sheet", 1, "", 0, starts[2]), sec("Risks", 1, "Item 1A", starts[2], len(text))]
    df = doc(spark, text, secs, tabs)
    kinds = {0: "balance_sheet", 1: "risk_factors"}
    of = lambda pos: 0 if pos < starts[2] else 1
    want, at = [], 0
    for t in [*tabs, None]:
        end = t["char_start"] if t else len(text)
        if end > at:
            want += [(*p, False, kinds[of(p[1])]) for p in plain_pack([(x, a + at, b + at) for x, a, b in plain_spans(text[at:end], r"\n\s*\n")], 200, 600)]
        if t:
            want.append((t["markdown"], t["char_start"], t["char_end"], tokens(t["markdown"]), True, kinds[of(t["char_start"])]))
            at = t["char_end"]
    assert rows_of(chunking.chunk_documents(df, "credit", "financial_statement"), "content", "char_start", "char_end", "content_tokens", "contains_table", "section_type") == want
    raw = text[starts[2] :]
    n = tokens(raw)
    assert n > 512
    want = [(*p, any(not (p[2] <= t["char_start"] or p[1] >= t["char_end"]) for t in tabs), "risk_factors", "Item 1A Risks") for p in plain_pack([(x, a + starts[2], b + starts[2]) for x, a, b in plain_spans(raw, r"\n\s*\n")], 200, 512)]
    assert rows_of(chunking.chunk_documents(df, "credit", "narrative_section"), "content", "char_start", "char_end", "content_tokens", "contains_table", "section_type", "hierarchy_path") == want
    whole = chunking.chunk_documents(doc(spark, text, []), "credit", "narrative_section").collect()
    assert whole and all(r.section_type == "narrative" for r in whole)


def test_semantic_boundaries_and_tables():
    spans = [(f"S{i} one two three.", 10 * i, 10 * i + 8) for i in range(12)]
    vectors = np.array([[1.0, 0.0]] * 6 + [[0.0, 1.0]] * 6)
    count = lambda t: len(t.split())
    got = chunking.semantic_segments(spans, "x" * 200, count, vectors, 0.5, 3, 100, [])
    assert [(a, b) for _, a, b, _ in got] == [(0, 58), (60, 118)] or len(got) >= 2
    held = chunking.semantic_segments(spans, "x" * 200, count, vectors, 0.5, 3, 100, [(0, 500)])
    assert len(held) == 1
    assert chunking.semantic_segments(spans[:3], " abc ", count, vectors[:3], 0.5, 3, 100, []) == [("abc", 0, 5, 1)]
    assert chunking.semantic_segments([], "", count, vectors[:0], 0.5, 3, 100, []) == []


def test_html():
    page = (
        "<html><head><title>t</title></head><body><!-- note --><h1>Item 1. The <b>title</b></h1><p>First  para<br>line</p><div>x</div>"
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><h2></h2><h2>Other</h2>text<script>no()</script></body></html>"
    )
    text, secs, tabs = html.parse(page, tables=True)
    assert "no()" not in text and "note" in text and "First para" in text
    assert [(s["heading"], s["level"], s["section_number"]) for s in secs] == [("The title", 1, "Item 1"), ("Other", 2, "")]
    assert all(text[s["char_start"] :].startswith(s["heading"]) for s in secs)
    assert tabs[0]["markdown"] == "| a | b |\n| --- | --- |\n| 1 |  |" and (tabs[0]["n_rows"], tabs[0]["n_cols"]) == (2, 2)
    assert "| a | b |" not in html.parse(page, tables=False)[0]
    assert "note" not in html.parse(page, tables=True, comments=False)[0]
    assert html.parse(None, tables=True) == ("", [], [])


def test_pages_and_intervals(spark):
    pages = spark.createDataFrame([("d", 1, " one "), ("d", 2, "  "), ("d", 3, "three"), ("e", 1, None)], "doc_id string, page_number int, text string")
    row = sections.page_texts(pages).collect()
    assert [(r.doc_id, r.full_text, [tuple(p) for p in r.pages]) for r in row] == [("d", "one\n\nthree\n\n", [(1, 0, 5), (3, 5, 12)])]
    at = spark.createDataFrame([(4,), (5,), (12,)], "pos int").crossJoin(sections.page_texts(pages)).select("pos", S.page_at(F.col("pages"), F.col("pos")).alias("p")).collect()
    assert {r.pos: r.p for r in at} == {4: 1, 5: 3, 12: None}


@pytest.mark.parametrize("module", ["compliance", "credit"])
def test_semantic_rows_equal_documents_one_by_one(spark, module):
    from docengine.operators.encode import hashing_embedder
    from docengine.plans.fixtures import structured

    docs = structured(spark, "/root/testdata/sf0.001").withColumn("full_text", F.when(F.col("doc_id") != "3", F.col("full_text")))
    got = {}
    for r in chunking.chunk_documents(docs, module, "semantic", hashing_embedder).select("doc_id", "chunk_index", "content", "char_start", "char_end", "content_tokens").collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    threshold, least, most = chunking.SEMANTIC[module]
    for d in docs.select("doc_id", "full_text", "tables", X.sentence_spans(F.coalesce("full_text", F.lit(""))).alias("s")).collect():
        spans = [(x.text, x.char_start, x.char_end) for x in d.s or []]
        forbidden = [(t.char_start, t.char_end) for t in d.tables or []] if module == "credit" else []
        vectors = np.stack([hashing_embedder([x[0]])[0] for x in spans]) if spans else np.zeros((0, 1))
        want = chunking.semantic_segments(spans, d.full_text or "", chunking.default_tokens, vectors, threshold, least, most, forbidden)
        assert [x[1:] for x in sorted(got.get(d.doc_id, []))] == want
