"""Exact dedup, filter audit and collocations against brute force on small tables, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from odd import LONG, ODD
from pyspark.sql import functions as F

from jobsift.llm import op11_exact_dedup as o11
from jobsift.llm import op12_filter_audit as o12
from jobsift.llm import op13_collocations as o13

RNG = random.Random(5)
WORDS = ["Alpha", "beta", "gamma", "delta.", "eps", "zeta,", "eta", "theta\n", "x|y", "日本。"]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---------------------------------------------------------------- 11


def test_chunks_are_the_text_and_follow_content(spark):
    text = prose(20_000, 1)
    unbroken = "q" * 9001 + "\U0001F600" * 5000
    rows = [text, "an inserted start. " + text, unbroken, ""]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "text string").select(o11.chunks(F.col("text"))).collect()]
    assert ["".join(c) for c in out] == rows and all(len(c) <= o11.MAX_CHARS for cs in out for c in cs)
    assert [len(c) for c in out[2]] == [4096, 4096, 4096, 1713] and out[3] == [""]
    shared = set(out[0]) & set(out[1])
    assert len(out[0]) > 100 and len(shared) >= len(set(out[0])) - 3  # a change at the start moves no later border


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, (t or "")): (max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows}


@pytest.mark.parametrize("hashed", [o11.chunk_hash, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_exact_copies(spark, docs_of, hashed):
    """Also where nearly all chunks share a hash: identifiers are verified by content."""
    base = [prose(n, n) for n in (1, 5, 300, 301, 4000)] + [LONG, "", None, " ", "a", "A"]
    rows = [(i, RNG.choice(base)) for i in range(80)] + [(7, "twice"), (7, "twice"), (None, "a"), (None, "no id"), (None, None)]
    got = o11.exact_copies(docs_of(rows), hashed=hashed).collect()
    want = brute_copies(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in want}
    assert len(got) == len(rows) and got[0]["key"] == "key"
    kept = Counter()
    for r in got:
        t = sha[r["copies"]["text_sha256"]]
        assert (r["copies"]["keep_id"], r["copies"]["group_size"]) == want[r["doc_id"], t]
        if r["copies"]["kept"]:
            kept[t] += 1
            assert r["doc_id"] == r["copies"]["keep_id"]
    assert kept == Counter({t: 1 for _, t in want})


def test_drop_copies(spark, docs_of):
    rows = [(1, "same"), (2, "same"), (3, None), (4, ""), (5, "other"), (5, "other"), (5, "else"), (None, "same"), (None, "alone")]
    out = o11.drop_copies(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == [("2", "same"), ("4", ""), ("5", "else"), ("5", "other"), ("None", "alone")]
    assert out[0]["comp"] == "comp"


def test_a_clashing_name_stays(spark, docs_of):
    named = o11.exact_copies(docs_of([(1, "a")]).selectExpr("*", "1 AS copies")).first()
    assert named["copies"] == 1 and named["copies_"]["kept"]


# ---------------------------------------------------------------- 12


def fails(text, smaller):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return {x for x, bad in [("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                             ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))), ("E", smaller)] if bad}


def brute_audit(rows, labels):
    """Every order run through, document by document."""
    least, good, toxic = {}, {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = [(lang or "", fails(t or "", i is not None and i > least[t or ""]), i in good, i in toxic) for i, t, lang in rows]
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            alive = list(mine)
            for k, f in enumerate(order):
                gone = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                failing = sum(f in d[1] for d in mine)
                out[part, "".join(order), k + 1] = [len(alive), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
    shapley = Counter()
    for (part, order, k), v in out.items():
        shapley[part, order[k - 1]] += v[1]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_rows(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS part", "0 AS pattern", "1 AS n", "2 AS digest")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' AS id", "3 AS good")
    got = o12.audit(o12.patterns(o12.marked_rows(docs, marks))).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got}


def test_filter_audit_is_every_order(spark):
    rng = random.Random(9)
    kinds = ["", None, "few words", "THE BIG", "a $ sign", prose(250, 3).replace("x|y", "w"), prose(250, 3), LONG, " ".join(f"w{i}" for i in range(300)), "few words #2"]
    rows = [(i, rng.choice(kinds), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(3, "few words", "en"), (3, "few words", "de"), (None, "few words", "en"), (None, "alone", None), (None, "alone", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    assert audit_rows(spark, rows, labels) == brute_audit(rows, labels)


def test_filter_audit_without_rows(spark):
    assert audit_rows(spark, [], []) == {}
    only = audit_rows(spark, [(1, None, None)], [])
    assert len(only) == 600 and only["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and only["", "BACDE", 1] == (1, 0, 0, 0, 0, 0, 0)


# ---------------------------------------------------------------- 13


def brute_phrases(rows, top=2000, least=30):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    cand = {g: n for g, n in f.items() if len(g[1]) > 1 and n >= least}
    dropped = {(lang, w[i:i + k]) for (lang, w), n in cand.items() for k in (2, 3) if k < len(w) for i in range(len(w) - k + 1)
               if 100 * n >= 80 * f[lang, w[i:i + k]]}
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in dropped:
            score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, rank): (p.decode(), -a, l, r, total[lang], -s)
            for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def found_phrases(frame, **how):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in o13.collocations(frame, **how).collect()}


@pytest.mark.parametrize("shard_bytes", [300, 5000, 12_000_000])
def test_collocations(spark, shard_bytes):
    """One shard or hundreds, also shards smaller than a text: the same counts."""
    rng = random.Random(2)
    words = ["The", "cat", "of", "it", "a", "ÄB", "\x00", "\x1f", "ß", "e"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" "] * 9 + ["\t ", ", ", "\n", "!"]) for _ in range(rng.randint(0, 300))))
            for _ in range(150)] + [("en", None), ("en", ""), (None, " \t"), ("fr", "once only"), ("en", "New York Times " * 40), ("en", "alone " * 100)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "'s' AS shard", "2 AS phrase").repartition(5)
    want = brute_phrases(rows)
    assert len(want) > 100 and found_phrases(docs, shard_bytes=shard_bytes) == want


def test_collocations_top_and_ties(spark):
    rows = [("en", f"x{i} y{i}. " * 30) for i in range(20)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found_phrases(docs, top=7) == brute_phrases(rows, top=7)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert found_phrases(docs) == {}
    assert found_phrases(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")) == {}


def test_index_extends_both_ways():
    """Intervals on both sides against a plain search, whichever way a phrase grew."""
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 5, 3000), [0]])
    index = o13.WordIndex(words, 4)
    ids, at, back, n = index.single()
    plain = Counter(tuple(words[i:i + 4]) for i in range(len(words) - 3))
    for way in (("L", "L", "R"), ("R", "L", "L"), ("R", "R", "R"), ("L", "R", "L")):
        gram, state = ids[None, :], (at, back, n)
        for step in way:
            owner, word, *state = (index.extend_left if step == "L" else index.extend_right)(*state)
            gram = np.vstack([word, gram[:, owner]] if step == "L" else [gram[:, owner], word])
        got = dict(zip(map(tuple, gram.T.tolist()), state[2].tolist()))
        assert got == {tuple(map(int, g)): c for g, c in plain.items() if 0 not in g}


@pytest.mark.parametrize("operator", [
    lambda d: o11.exact_copies(d).select("doc_id"),
    lambda d: o11.drop_copies(d).select("doc_id"),
    lambda d: o13.collocations(d),
])
def test_odd_and_empty_tables(spark, docs_of, operator):
    operator(docs_of(ODD)).collect()
    assert operator(docs_of([])).collect() == []
