"""Each query with SQL against DuckDB, and the odd rows through every operator."""

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from jobsift.llm import catalog
from jobsift.llm import op1_token_output as o1
from jobsift.llm import op2_quality_rules as o2
from jobsift.llm import op3_fingerprints as o3
from jobsift.llm import op4_near_dedup as o4
from jobsift.llm import op5_line_dedup as o5
from jobsift.llm import op6_sentencepiece as o6
from jobsift.llm import op7_toxicity as o7
from jobsift.llm import op8_pii_surrogates as o8
from jobsift.llm import op9_license_digests as o9
from jobsift.llm import op10_bounded_packing as o10
from odd import ODD

catalog.load_all()
SF_SMALL = "/root/testdata/sf0.001"
NATIVE = ["op2_quality_rules", "op3_fingerprints", "op5_line_dedup", "op8_pii_surrogates", "op9_license_digests", "op11_exact_dedup"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), catalog.ORACLE[name]) is None


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_run_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop") if x in plan]


OPERATORS = {
    "1": lambda spark, d: o1.pack_best_fit(d).select(F.explode("doc_ids").alias("doc_id")),
    "2": lambda spark, d: o2.quality_rules(d),
    "3": lambda spark, d: o3.with_next(d),
    "4": lambda spark, d: o4.near_duplicates(d),
    "5": lambda spark, d: o5.drop_lines(d, min_docs=2),
    "6": lambda spark, d: o6.encode_pieces(d),
    "7": lambda spark, d: o7.scored(d, o7.fit([("bad awful", 1, "en"), ("fine good", 0, "en")] * 8, 0.5)),
    "8": lambda spark, d: o8.replace_pii(d),
    "9": lambda spark, d: o9.scan_licenses(d),
    "10": lambda spark, d: o10.pack_windows(d),
}


@pytest.mark.parametrize("number", sorted(OPERATORS))
def test_odd_rows(spark, docs_of, number):
    out = OPERATORS[number](spark, docs_of(ODD)).collect()
    if number not in ("1", "10"):
        assert len(out) == len(ODD)
    else:
        assert {r["doc_id"] for r in out} == {i for i, _ in ODD}


@pytest.mark.parametrize("number", sorted(OPERATORS))
def test_empty_table(spark, docs_of, number):
    assert OPERATORS[number](spark, docs_of([])).collect() == []


def test_quality_rules(spark, docs_of):
    rows = [(1, "the cat of the house is in that room and it was for us"), (2, "few words"), (3, "### &&& $$$ " * 20), (4, "a b c d e " * 9), (5, None),
            (6, "same line of the text\n" * 6 + "and this is one more line of it")]
    got = {r["doc_id"]: r["quality"] for r in o2.quality_rules(docs_of(rows)).collect()}
    assert got[1]["kept"] and not got[1]["base_failed"]
    assert got[2]["base_failed"] and got[5]["n_words"] == 0 and got[5]["base_failed"]
    assert got[3]["n_symbols"] == 180 and "too_many_symbols" in got[3]["failed_rules"]
    assert got[4]["n_repeat_words"] == got[4]["n_words"] == 45
    assert got[6]["n_dup_lines"] == 5 and "repeated_lines" in got[6]["failed_rules"]


def test_bottom_k(spark, docs_of):
    words = [f"w{i}" for i in range(3000)]
    texts = {1: " ".join(words), 2: " ".join(words[:1500]), 3: " ".join(words[1500:]), 4: "other " * 3 + "text", 5: ""}
    s = {r["doc_id"]: r["sketch"] for r in o3.fingerprints(docs_of(texts.items(), extra=False)).collect()}
    one = spark.createDataFrame([(s[1], s[2], s[3], s[4], s[5])], "a array<string>, b array<string>, c array<string>, d array<string>, e array<string>")
    r = one.select(o3.resemblance(F.col("a"), F.col("b")).alias("ab"), o3.containment(F.col("b"), F.col("a")).alias("b_in_a"), o3.distinct_shingles(F.col("a")).alias("n"),
                   o3.resemblance(F.col("a"), F.col("d")).alias("ad"), o3.resemblance(F.col("e"), F.col("e")).alias("ee")).first()
    assert abs(r.ab - 0.5) < 0.2 and r.b_in_a > 0.7 and abs(r.n / 2996 - 1) < 0.4 and r.ad == 0 and r.ee == 1
    parts = spark.createDataFrame([("x", s[2]), ("x", s[3]), ("y", s[5])], "k string, sketch array<string>")
    merged = {r["k"]: r["sketch"] for r in o3.merge_sketches(parts, "k", "sketch").collect()}
    assert merged["y"] == [] and len(set(merged["x"]) & set(s[1])) >= 60  # the part's borders cut 4 shingles


def test_line_runs(spark, docs_of):
    rows = [(1, "Top\n x \nkeep 1"), (2, "top\nX\nkeep 2\n\n\ntop"), (3, "only"), (4, None)]
    got = {r["doc_id"]: r["text"] for r in o5.drop_lines(docs_of(rows), min_docs=2).collect()}
    assert got == {1: "keep 1", 2: "keep 2\n\n", 3: "only", 4: None}
    first = {r["doc_id"]: r["text"] for r in o5.drop_lines(docs_of(rows), min_docs=2, keep_first=True).collect()}
    assert first == {1: "Top\n x \nkeep 1", 2: "keep 2\n\n", 3: "only", 4: None}


def test_licenses(spark, docs_of):
    mit = "Copyright (c) 2020 Somebody\n\n" + o9._MIT.upper().replace(",", " ,").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")
    rows = [(1, mit), (2, "text\n  released under the mit licence!\nmore"), (3, "Released under the MIT License, I think."), (4, "")]
    got = {r["doc_id"]: r for r in o9.scan_licenses(docs_of(rows)).collect()}
    assert got[1].license == "MIT" and got[2].license is None and got[2].notices == ["MIT"] and got[3].notices == [] and got[4].digest is None


def test_further_known_texts(spark, docs_of):
    full = "Some Public License\nVersion 9\n\nEveryone may copy this text.\nNo warranty."
    rows = [(1, full.upper()), (2, "Released under the MIT License."), (3, "before\n" + full)]
    got = {r["doc_id"]: r["license"] for r in o9.scan_licenses(docs_of(rows), [*o9.KNOWN_TEXTS, ("SPL-9", full)]).collect()}
    assert got == {1: "SPL-9", 2: "MIT", 3: None}
