"""Every labelled row teaches the toxicity model, however many there are (F6 of the fourth round)."""

import zlib

import numpy as np
import pytest

from jobsift.llm import op7_toxicity as o7

KINDS = 60


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic texts hold one of sixty bad words, more than a small sample shows; half of the rows say nothing of toxicity."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    bad = ["".join(rng.choice(letters, 7)) for _ in range(KINDS)]
    good = ["".join(rng.choice(letters, 6)) for _ in range(KINDS)]
    rows = []
    for i in range(3000):
        words = [*rng.choice(good, 6), bad[i % KINDS] if i % 3 == 0 else str(rng.choice(good))]
        rows.append((i, " ".join(rng.permutation(words)), "en", int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    return docs.cache(), labels.cache(), {i: y for i, _, _, y in rows}


def test_words_outside_the_sample_are_learned(spark, labelled, monkeypatch):
    docs, labels, toxic = labelled
    monkeypatch.setattr(o7, "SHARD", 500)
    monkeypatch.setattr(o7, "ADDED", 2)
    model = o7.fitted(docs, labels, sample=40)
    got = {r["doc_id"]: r["score"] for r in o7.scored(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([(s >= 0.5) == toxic[i] for i, s in got.items()]) > 0.95


def test_all_rows_are_read_and_order_does_not_matter(spark, labelled, monkeypatch):
    docs, labels, toxic = labelled
    monkeypatch.setattr(o7, "SHARD", 500)
    seen = []
    learned = o7.learned
    monkeypatch.setattr(o7, "learned", lambda rows, *a: seen.append(rows.count()) or learned(rows, *a))
    decisive = o7.decisive
    monkeypatch.setattr(o7, "decisive", lambda core, z, y, w, *a: seen.append(int(w.sum())) or decisive(core, z, y, w, *a))
    one, two = o7.fitted(docs, labels, sample=40), o7.fitted(docs.repartition(7, "n_chars"), labels.repartition(3), sample=40)
    assert sum(seen[:2]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in toxic) and min(seen) > 0
    assert np.array_equal(one.table, two.table) and one.scale == two.scale and one.thresholds == two.thresholds


def test_labels_of_one_kind(spark, labelled):
    docs, labels, _ = labelled
    model = o7.fitted(docs, labels.where("toxic = 0"), sample=40)
    assert [r["score"] for r in o7.scored(docs.limit(3), model).collect()] == pytest.approx([0.0] * 3, abs=1e-6)
