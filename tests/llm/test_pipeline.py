"""The pipeline, stage by stage, against the operators' brute force on a small table."""

import hashlib

import pytest

import corpus_pipeline
from granary.llm import common
from tests.llm.test_rowwise import library_bpe
from tests.llm.test_sets import brute_join, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input, and what each stage gives."""
    out = [common.documents(spark, SF).collect()]
    docs = common.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def test_columns(stages):
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_languages_keep_clean_documents(stages):
    before, after = stages[0], stages[1]
    assert {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)} == {r.doc_id for r in after}


def test_lines(stages):
    want = brute_lines([(r.doc_id, r.text) for r in stages[1]], 50)
    assert {(r.doc_id, r.text, r.n_chars) for r in stages[2]} == {(d, t, len(t)) for (d, _), t in want.items() if t.strip(" ")}


def test_one_document_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[2]]
    kept = {d for d, _, least in brute_join(rows) if d == least}
    assert sorted(r.doc_id for r in stages[3]) == sorted(kept)


def test_rows_that_share_an_id(spark):
    """Different texts under one id are told apart, near copies go whatever their ids, and of rows equal in both one stays."""
    words = [f"w{i}" for i in range(60)]
    a, near, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(reversed(words))
    rows = [(1, a), (1, other), (2, near), (None, near), (None, "a text without an id"), (None, "a text without an id"), (1, a), (3, None), (4, ""), (3, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (1, other), (None, "a text without an id"), (3, None), (4, "")], key=str)


def test_tables_go_with_their_stage(spark):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    with common.own_tables() as keep:
        common.materialize(spark.range(3), "gone")
        kept = keep(common.materialize(spark.range(4), "kept-table"))
    assert kept.count() == 4 and not list(folder.glob("gone-*")) and len(list(folder.glob("kept-table-*"))) == 1


def test_mixing_adds_no_texts(stages):
    before = {r.doc_id: r.text for r in stages[3]}
    assert stages[4] and all(before[r.doc_id] == r.text for r in stages[4])


def test_tokens(stages):
    library, _ = library_bpe()
    texts = {r.doc_id: r.text for r in stages[4]}
    assert sorted(r.doc_id for r in stages[5]) == sorted(r.doc_id for r in stages[4])
    for r in stages[5]:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_and_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows and ids, through all stages."""
    docs = common.documents(spark, SF).limit(60)
    odd = [(None, "words without an id here", "en", "s", 1), (5000, None, None, None, None), (5001, "", "en", "s", 0), (5002, "x " * 20_000, None, "s", 1), (5002, "x " * 20_000, None, "s", 1)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {5000, 5001}.isdisjoint({r.doc_id for r in got})
    none = tmp_path / "none"
    docs.where("false").write.parquet(str(none / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(str(none / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(none)).collect() == []
