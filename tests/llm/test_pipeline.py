"""The pipeline's stages and its whole run against plain Python, on a table with groups of copies."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_exact import SF, brute_components

import corpus_pipeline
from jobsift.llm import op10_bounded_packing as o10
from jobsift.llm.common import documents
from jobsift.llm.word_ids import default_tokenizer

PRIVATE = [("ann.lee@mail.org", "25a0bc4376e17c80"), ("bob@other.net", "25a0bc4376e17c80"), ("ann.lee@mail.org", "77e1aa0b9c3d5f21")]
TEMPLATE = "Text {} of the set\nwrite to {} about it\nthe password={} opens it"
COPIES = [(10_000 + i, "a line that many have\nand one more of this group\n\nits last line") for i in range(14)]
COPIES += [(20_000 + i, f"a line that many have\nwhat only the text {'abcdefghijkl'[i] * 3} says here") for i in range(12)]
HIDING = [(30_000 + i, TEMPLATE.format("xyz"[i] * 4, *p)) for i, p in enumerate(PRIVATE)]


def brute_lines(rows):
    """Texts without the lines of ten documents or more, but for their first places."""
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))

    seen, first, out = defaultdict(set), {}, {}
    for i in sorted(rows):
        for pos, line in enumerate((rows[i] or "").split("\n")):
            seen[key(line)].add(i)
            first.setdefault(key(line), (i, pos))
    for i, text in rows.items():
        lines = (text or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if not key(x) or len(seen[key(x)]) < 10 or first[key(x)] == (i, pos)]
        out[i] = text if len(kept) == len(lines) else "\n".join(kept)
    return out


def ids_of(rows):
    """Ids of each document from its pieces, which must lie end to end in it and in their sequence."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for parts in sequences.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist()
    out = {}
    for i, parts in pieces.items():
        ids = [np.frombuffer(x, "<u4").tolist() for _, x, _ in sorted(parts)]
        assert [s for s, *_ in sorted(parts)] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
        out[i] = sum(ids, [])
        assert {n for *_, n in parts} == {len(out[i])}
    return out


def packed_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, o10.CLOSING_ID] for i, x in texts.items()}


def put(template_rows, new):
    """What the surrogates of the private values are, by value; the text around them must be as it was."""
    found = defaultdict(set)
    for (i, _), private in zip(template_rows, PRIVATE, strict=True):
        m = re.fullmatch(re.escape(TEMPLATE.format("xyz"[i - 30_000] * 4, "@1", "@2")).replace("@1", r"(\S+@\S+)").replace("@2", "([0-9a-f]{16})"), new[i])
        assert m, new[i]
        for value, surrogate in zip(private, m.groups(), strict=True):
            found[value].add(surrogate)
    assert all(len(s) == 1 and value not in s for value, s in found.items())
    assert max(Counter(x for s in found.values() for x in s).values()) == 1


@pytest.fixture
def table(docs_of):
    return docs_of(COPIES + HIDING, extra=False)


def test_stages(spark, table):
    before = dict(COPIES + HIDING)
    lined = corpus_pipeline.line_dedup(spark, table, SF).collect()
    assert {r["doc_id"]: r["text"] for r in lined} == brute_lines(before)
    assert brute_lines(before)[10_000] == before[10_000] and brute_lines(before)[10_001] == ""
    hidden = {r["doc_id"]: r["text"] for r in corpus_pipeline.pii(spark, table, SF).collect()}
    assert {i: hidden[i] for i, _ in COPIES} == dict(COPIES) and len(hidden) == len(before)
    put(HIDING, hidden)
    assert ids_of(corpus_pipeline.packing(spark, table, SF).collect()) == packed_ids(before)


def test_run(spark, table, tmp_path):
    sf = str(tmp_path)
    docs = documents(spark, SF)
    docs.unionByName(table.select(*docs.columns)).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.toxicity(spark, documents(spark, sf), sf).collect()}
    lined = brute_lines(clean)
    least, _ = brute_components(lined, 5)
    want = {i: t for i, t in lined.items() if least[i] == i}
    got = ids_of(corpus_pipeline.run(spark, sf).collect())
    assert set(got) == set(want)
    plain = {i: t for i, t in want.items() if not re.search(r"[0-9@=:]|\b(M[rs]|Miss|Herr|Frau|Mon|Mme|Mad|Se.or|Sign)|[^\x00-\xff]", t or "")}
    assert len(plain) > 20 and {i: got[i] for i in plain} == packed_ids(plain)
