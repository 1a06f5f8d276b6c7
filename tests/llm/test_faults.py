"""Cases that went wrong once: number widths, names that clash, rows that share a doc_id."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobsift.llm import op1_token_output as o1
from jobsift.llm import op2_quality_rules as o2
from jobsift.llm import op3_fingerprints as o3
from jobsift.llm import op4_near_dedup as o4
from jobsift.llm import op7_toxicity as o7
from jobsift.llm import op8_pii_surrogates as o8
from jobsift.llm.word_ids import default_tokenizer


def test_long_rows_get_wide_numbers(spark, docs_of):
    """70,001 tokens in one row of 131,072: positions do not wrap."""
    docs = docs_of([(1, "word " * 70_000)], extra=False)
    row = o1.pack_best_fit(docs, capacity=131_072).first()
    ids, places = o1.matrix([row], 131_072)
    assert row["n_tokens"] == 70_001 and places[0, :70_001].tolist() == list(range(70_001)) and ids[0, 70_000] == o1.CLOSING_ID
    with pytest.raises(ValueError):
        o1.pack_best_fit(docs, capacity=131_072, wide=False)
    with pytest.raises(ValueError):
        o1.pack_best_fit(docs, closing_id=70_000, wide=False)
    assert o1.number_kind(default_tokenizer(), 65_536, o1.CLOSING_ID, None) == "<u2"


@pytest.mark.parametrize("wide", [None, True])
def test_written_matrices(spark, docs_of, tmp_path, wide):
    rows = [(i, "some words of text " * (i * 37 % 50)) for i in range(60)]
    o1.write_matrices(o1.pack_best_fit(docs_of(rows), capacity=256, wide=wide), str(tmp_path / "m"))
    from tokenizers import Tokenizer

    t, found = Tokenizer.from_file(default_tokenizer()), {}
    for file in glob.glob(str(tmp_path / "m" / "*.parquet")):
        table = pq.read_table(file)
        ids, places = o1.matrix(table, 256)
        assert ids.shape == places.shape == (table.num_rows, 256) and ids.dtype == np.dtype("<u4" if wide else "<u2")
        for line, place, row in zip(ids, places, table.to_pylist(), strict=True):
            ends = row["cu_seqlens"]
            assert ends[0] == 0 and ends[-1] == row["n_tokens"] and (line[ends[-1]:] == o1.CLOSING_ID).all()
            for a, b, doc, start in zip(ends, ends[1:], row["doc_ids"], row["starts"], strict=False):
                assert place[a:b].tolist() == list(range(b - a))
                found.setdefault(doc, {})[start] = line[a:b].tolist()
    for i, text in rows:
        assert sum((x for _, x in sorted(found[i].items())), []) == [*t.encode(text, add_special_tokens=False).ids, o1.CLOSING_ID]


@pytest.mark.parametrize(("name", "operator", "kind"), [
    ("quality", lambda d: o2.quality_rules(d), "struct"),
    ("sketch", lambda d: o3.fingerprints(d), "array"),
    ("score", lambda d: o7.scored(d, o7.fit([("bad awful", 1, "en"), ("fine good", 0, "en")] * 8, 0.5)), "double"),
    ("pii", lambda d: o8.replace_pii(d), "array"),
])
def test_a_clashing_name_stays(spark, docs_of, name, operator, kind):
    docs = docs_of([(1, "write to ann.lee@mail.org"), (2, None)], extra=False).withColumn(name, F.lit("mine"))
    out = operator(docs)
    assert out.columns == [*docs.columns, name + "_"] and dict(out.dtypes)[name + "_"].startswith(kind)
    assert {r[name] for r in out.collect()} == {"mine"}


def test_the_pii_stage_keeps_all_columns(spark, docs_of):
    docs = docs_of([(1, "write to ann.lee@mail.org"), (2, None)]).withColumns({"pii": F.lit(1), "pii_": F.lit(2)})
    out = corpus_pipeline.pii(spark, docs, "")
    assert out.columns == docs.columns and {(r["pii"], r["pii_"]) for r in out.collect()} == {(1, 2)}


def test_kept_is_the_least_id_of_the_component(spark, docs_of):
    """Rows that share a doc_id: kept goes by the ids, stays by each row's own text."""
    one, two = "a b c d e f g h", "q r s t u v w x"
    rows = {(r["doc_id"], r["kept"], r["component_id"], r["stays"]) for r in o4.near_duplicates(docs_of([(5, one), (5, two), (3, two), (None, "x")])).collect()}
    assert rows == {(5, False, 3, True), (5, False, 3, False), (3, True, 3, True), (None, None, None, True)}
    left = sorted((str(r["doc_id"]), r["text"]) for r in o4.one_of_each(docs_of([(5, one), (5, two), (3, two)])).collect())
    assert left == [("3", two), ("5", one)]


def test_stages_take_odd_rows_and_empty_tables(spark, docs_of):
    from odd import ODD

    for rows in (ODD, []):
        docs = docs_of(rows)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            assert stage(spark, docs, "").columns == docs.columns, name
