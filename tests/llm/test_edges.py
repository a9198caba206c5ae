"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and pipeline stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from docengine.llm import bpe, decontamination, langid, licenses, lm, neardup, pii, quality, rules, toxicity
from docengine.llm.queries import BPE_RANKS, PIECES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, pii int, label int, __t string, h long, p long, component long, n_words string, decoded string, slice_ends array<int>, row string"


def rows():
    extra = (0.5, "i", 7, 9, "t", 1, 2, 3, "w", "d", [7], "r")
    long = ("lorem ipsum dolor " * 12000).strip()
    texts = ["A plain text of some words, nothing else.", None, "", " \n\t ", "x", long, "y" * 150_000, "A plain text of some words, nothing else.", "éß 漢字 🙂 \x00 é", "1" * 30_000 + "+1 2 3" + "a@" * 20_000]
    out = [(i, t, None if i % 3 == 0 else "en", None if i == 1 else "s", None, *extra) for i, t in enumerate(texts)]
    return out + [out[0], (None, "no id at all", "en", "s", 1, *extra), (None, None, None, None, None, *extra)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, None, 0), (4, 0, 1), (5, 1, 0), (6, 0, 1), (None, 1, 1), (99, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "A plain text of some words, nothing else."), (1, None), (2, ""), (3, "x")], "item_id long, text string")


REPORTS = {
    "licenses": lambda d, la, b: licenses.report(d),
    "quality": lambda d, la, b: quality.classify(d, la),
    "langid": lambda d, la, b: langid.identify(d),
    "rules": lambda d, la, b: rules.judge(d, la),
    "lm": lambda d, la, b: lm.report(d, public_tokenizers.path(PIECES)),
    "toxicity": lambda d, la, b: toxicity.classify(d, la),
    "pii": lambda d, la, b: pii.report(d),
    "neardup": lambda d, la, b: neardup.report(d),
    "bpe": lambda d, la, b: bpe.digest(d, public_tokenizers.path(BPE_RANKS)),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_every_row_has_a_result(docs, labels, benchmark, name):
    out = REPORTS[name](docs, labels, benchmark).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows())
    same = [tuple(r) for r in out if r.doc_id == 0]
    assert len(same) == 2 and same[0] == same[1]
    for field in ("score", "predicted", "kept"):
        if field in out[0].asDict():
            assert all(r[field] is not None for r in out)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_empty_tables(spark, docs, labels, benchmark, name):
    assert REPORTS[name](docs.where("false"), labels.where("false"), benchmark).count() == 0
    if name in ("quality", "toxicity", "rules"):
        assert REPORTS[name](docs, labels.where("false"), benchmark).count() == len(rows())


def test_leaks_of_edge_rows(docs, benchmark):
    found = sorted((r.doc_id, r.item_id, r.similarity) for r in decontamination.leaks(docs, benchmark).collect())
    assert found == [(0, 0, 1.0), (0, 0, 1.0), (4, 3, 1.0), (7, 0, 1.0)]
    assert decontamination.leaks(docs, benchmark.where("false")).count() == 0
    assert decontamination.leaks(docs.where("false"), benchmark).count() == 0


@pytest.fixture(scope="module")
def tables(tmp_path_factory, labels, benchmark):
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_edge_rows(spark, docs, tables, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, docs, tables)
    if stage != "byte_bpe":
        assert out.columns == docs.columns
        assert dict(out.dtypes) == dict(docs.dtypes)
    got = out.collect()
    ids = sorted(str(r.doc_id) for r in got)
    every = sorted(str(r[0]) for r in rows())
    if stage in ("pii", "byte_bpe"):
        assert ids == every
    if stage == "byte_bpe":
        assert {(r.decoded, tuple(r.slice_ends), r.row) for r in got} == {("d", (7,), "r")}
        assert all(r.text == (t or "") for r in got for i, t, *_ in rows() if i is not None and i == r.doc_id)
    if stage == "near_dedup":
        assert ids == sorted(i for i in every if i != "7")  # both rows of id 0 stay, and the rows without an id
    if stage == "decontamination":
        assert set(every) - set(ids) == {"0", "4", "7"}
    assert f(spark, docs.where("false"), tables).count() == 0
