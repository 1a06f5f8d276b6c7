"""Toxicity (7): a convolutional text classifier, trained in numpy.

A word's vector is the mean of the hashed embeddings of the word and of its
first three, four and five characters.  Filters of several widths run over the
word vectors of the whole text; each filter's maximum over all positions
enters one logistic layer.  The score is calibrated on rows kept from
training, weighted to the labels' real share; per language, a threshold for
the decision is calibrated on the same rows.  Label, language, source and
doc_id never enter a score.

Training reads every labelled row.  Up to ``SAMPLE`` of them are fitted on the
driver.  With more, a sample of that size (half of it toxic, if there are so
many, chosen by a hash of doc_id) gives the start alone: from there Spark's
tasks go over all rows, dealt by a hash into shards of about ``SHARD``, and
what the shards have learned is averaged; rows kept from training are scored by
Spark and calibrate by counts of their logits, to hundredths.  Scoring is done
by Spark over all rows.

Defined results: null and empty texts get the score of a text without words;
repeated rows get equal scores; without labels of both kinds every score is
the share of toxic labels (0 without labels); an empty table gives no rows;
other columns are passed on by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift.llm.catalog import register
from jobsift.llm.common import by_value, documents, free_name, whole_text
from jobsift.llm.word_ids import worker_memory
from jobsift.session import shuffles_removed

SAMPLE = 4000
#: Rows of a shard, rows of it that are learned together, and shards whose sums are added in one task.
SHARD, LEARNED_ROWS, ADDED = 4096, 512, 16
BUCKETS, WIDTH, FILTERS, WINDOWS = 1 << 15, 16, 12, (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Share of the sample kept from training, for calibration.
HELD = 0.25
#: A language with fewer rows of either kind among the kept ones takes the threshold of all.
LEAST_ROWS = 15
MAX_WORDS, STEP_WORDS = 150_000, 100_000
#: Texts of a batch that are copied out at once.
STEP_ROWS = 500
PAD = max(WINDOWS) - 1
MARKS = ".,;:!?\"'()[]{}#*$%&|<>-"


class Model(NamedTuple):
    table: np.ndarray  # hashed embeddings; the last row is 0
    filters: tuple  # (weights, bias) for each window
    out: np.ndarray
    bias: float
    scale: float  # calibration: scale * logit + shift
    shift: float
    thresholds: dict  # by language; "" for the others
    share: float  # of toxic labels


class Buckets(dict):
    """(part of a word, which part) -> bucket."""

    def __missing__(self, part: tuple[str, int]) -> int:
        import xxhash

        bucket = self[part] = xxhash.xxh3_64_intdigest(part[0].encode(), seed=part[1]) % BUCKETS if part[0] else BUCKETS
        return bucket


def features(word: str, known: Buckets) -> list[int]:
    """Buckets of a word without marks and case: the whole and its first 3, 4 and 5 characters."""
    return [known[x] for x in ((word, 0), (word[:3], 1), (word[:4], 2), (word[:5], 3))]


def convolved(x: np.ndarray, filters: tuple, starts: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
    """Filter outputs at all positions (texts follow each other, each with PAD empty words at its end)."""
    out = []
    for (w, b), k in zip(filters, WINDOWS, strict=True):
        z = sum(x[j:len(x) - PAD + j] @ w[j] for j in range(k)) + b
        z[~real[:len(z)]] = -np.inf
        out.append(z)
    return out


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows of the texts one after the other, -1 for empty words; each text's start; where words are.

    A text without words gets one empty word that counts.
    """
    lengths = np.array([max(1, len(t)) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)])[:-1]
    rows, real = np.full(int((lengths + PAD).sum()), -1, np.int64), np.zeros(int((lengths + PAD).sum()), bool)
    for t, a, n in zip(texts, starts, lengths, strict=True):
        rows[a:a + len(t)], real[a:a + n] = t, True
    return rows, starts, real


class Learner:
    """The network while it is fitted, by Adam and for the embeddings by Adagrad."""

    def __init__(self, rng: np.random.Generator):
        self.table = np.concatenate([rng.normal(0, 0.1, (BUCKETS, WIDTH)), np.zeros((1, WIDTH))]).astype(np.float32)
        self.params = {"out": rng.normal(0, 0.1, FILTERS * len(WINDOWS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for k in WINDOWS:
            self.params[f"w{k}"] = rng.normal(0, (1 / (k * WIDTH)) ** 0.5, (k, WIDTH, FILTERS)).astype(np.float32)
            self.params[f"b{k}"] = np.zeros(FILTERS, np.float32)
        self.m, self.v = ({n: np.zeros_like(p) for n, p in self.params.items()} for _ in range(2))
        self.grown = np.zeros(BUCKETS + 1, np.float32)  # squared gradients of the embeddings, by row
        self.touched = np.zeros(BUCKETS + 1, np.float32)  # batches that moved a row
        self.step = 0

    def core(self) -> tuple:
        """(table, filters, out, bias)."""
        p = self.params
        return self.table, tuple((p[f"w{k}"], p[f"b{k}"]) for k in WINDOWS), p["out"], float(p["bias"][0])

    def learn(self, rng: np.random.Generator, texts: list[np.ndarray], buckets: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """One pass over the texts, rows of ``buckets`` (words x 4), in a random order."""
        table, params, m, v = self.table, self.params, self.m, self.v
        order = rng.permutation(len(texts))
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            rows, starts, real = laid_out([texts[i] for i in part])
            of = np.where((rows >= 0)[:, None], buckets[rows], BUCKETS)
            x = table[of].mean(1)
            filters = tuple((params[f"w{k}"], params[f"b{k}"]) for k in WINDOWS)
            pooled, places = [], []
            for z in convolved(x, filters, starts, real):
                ends = np.append(starts[1:], len(z))
                at = np.stack([a + z[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)])
                places.append(at)
                pooled.append(np.take_along_axis(z, at, 0))
            raw = np.concatenate(pooled, 1)
            hidden = np.maximum(raw, 0)
            kept = (rng.random(hidden.shape) > 0.2) / np.float32(0.8)
            logit = (hidden * kept) @ params["out"] + params["bias"]
            d = ((1 / (1 + np.exp(-logit)) - labels[part]) * weights[part] / len(part)).astype(np.float32)
            grads = {"out": (hidden * kept).T @ d + 1e-3 * params["out"], "bias": np.array([d.sum()])}
            back = (d[:, None] * params["out"] * kept * (raw > 0)).astype(np.float32)
            dx: dict[str, list] = {"at": [], "d": []}
            for n, (k, at) in enumerate(zip(WINDOWS, places, strict=True)):
                g = back[:, n * FILTERS:(n + 1) * FILTERS]
                grads[f"b{k}"] = g.sum(0)
                gw = np.zeros_like(params[f"w{k}"])
                for j in range(k):
                    gw[j] = np.einsum("bfd,bf->df", x[at + j], g)
                    dx["at"].append((at + j).ravel())
                    dx["d"].append((g[:, :, None] * params[f"w{k}"][j].T[None]).reshape(-1, WIDTH))
                grads[f"w{k}"] = gw
            self.step += 1
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                params[name] = (params[name] - RATE * (m[name] / (1 - 0.9**self.step)) / (np.sqrt(v[name] / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)
            at, g = np.concatenate(dx["at"]), np.concatenate(dx["d"])
            hit, inverse = np.unique(of[at].ravel(), return_inverse=True)
            total = np.zeros((len(hit), WIDTH), np.float32)
            np.add.at(total, inverse, np.repeat(g / 4, 4, axis=0))
            self.grown[hit] += (total**2).mean(1)
            self.touched[hit] += 1
            table[hit] -= 10 * RATE * total / (np.sqrt(self.grown[hit])[:, None] + 1e-6)
            table[BUCKETS] = 0


def trained(texts: list[np.ndarray], buckets: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Learner:
    """The network after ``EPOCHS`` passes over the texts."""
    rng = np.random.default_rng(seed)
    learner = Learner(rng)
    for _ in range(EPOCHS):
        learner.learn(rng, texts, buckets, labels, weights)
    return learner


def logits(texts: list[np.ndarray], vectors: np.ndarray, model: tuple) -> np.ndarray:
    """Logits of texts given as rows of word vectors."""
    _, filters, out, bias = model[:4]
    rows, starts, real = laid_out(texts)
    x = np.where((rows >= 0)[:, None], vectors[rows], np.float32(0)) if len(vectors) else np.zeros((len(rows), WIDTH), np.float32)
    pooled = [np.maximum.reduceat(z, starts, axis=0) for z in convolved(x, filters, starts, real)]
    return (np.maximum(np.concatenate(pooled, 1), 0) @ out + bias).astype(np.float64)


class WordRows(dict):
    """word -> row of its vector; words alike but for marks and case share one."""

    def __init__(self, model: Model):
        self.table, self.made = model.table, np.zeros((1024, WIDTH), np.float32)
        self.rows: dict[str, int] = {}
        self.buckets: list[list[int]] = []  # of the rows not made yet
        self.known = Buckets()

    def __missing__(self, word: bytes) -> int:
        plain = word.decode().lower().strip(MARKS)
        row = self.rows.get(plain)
        if row is None:
            row = self.rows[plain] = len(self.rows)
            self.buckets.append(features(plain, self.known))
        self[word] = row
        return row

    def vectors(self) -> np.ndarray:
        if self.buckets:
            n, first = len(self.rows), len(self.rows) - len(self.buckets)
            while n > len(self.made):
                self.made = np.concatenate([self.made, np.zeros_like(self.made)])
            self.made[first:n] = self.table[np.array(self.buckets)].mean(1)
            self.buckets = []
        return self.made

    def trimmed(self) -> None:
        """Between texts: start anew when full."""
        if len(self) > MAX_WORDS:
            for x in (self, self.rows, self.buckets, self.known):
                x.clear()

    def of(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").split()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def calibrated(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of weighted logistic regression on the logit, by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (p - y) * z).sum() + 0.1 * (a - 1), (w * (p - y)).sum() + 0.1 * b])
        s = w * p * (1 - p)
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(max(a, 1e-3)), float(b)


def best_threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Midway between the scores whose cut has the greatest weighted F1."""
    order = np.argsort(-p)
    hit, called = np.cumsum((w * y)[order]), np.cumsum(w[order])
    f1 = 2 * hit / (called + (w * y).sum())
    k = int(f1.argmax())
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


def indexed(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's words as rows of the second result: the buckets of the distinct words."""
    index: dict[bytes, int] = {}
    found = [np.array([index.setdefault(w, len(index)) for w in t.split()], np.int64) for t in texts]
    known = Buckets()
    return found, np.array([features(w.decode().lower().strip(MARKS), known) for w in index] or [[BUCKETS] * 4])


def constant(share: float) -> Model:
    """The model where the labels are not of both kinds."""
    table = np.zeros((BUCKETS + 1, WIDTH), np.float32)
    filters = tuple((np.zeros((k, WIDTH, FILTERS), np.float32), np.zeros(FILTERS, np.float32)) for k in WINDOWS)
    odds = np.log(np.clip(share, 1e-9, 1 - 1e-9) / (1 - np.clip(share, 1e-9, 1 - 1e-9)))
    return Model(table, filters, np.zeros(FILTERS * len(WINDOWS), np.float32), 0.0, 1.0, float(odds), {"": 0.5}, share)


def decisive(core: tuple, z: np.ndarray, y: np.ndarray, w: np.ndarray, rows: np.ndarray, langs: np.ndarray, share: float) -> Model:
    """The calibrated model, from logits of rows kept from training; an entry stands for ``rows`` rows, ``y`` of them toxic (a share)."""
    scale, shift = calibrated(z, y, w)
    p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -700, 700)))
    thresholds = {"": 0.5}
    for lang in sorted({*langs} - {""}):
        own = langs == lang
        few = int(round(min((rows * y)[own].sum(), (rows * (1 - y))[own].sum())))
        if few >= LEAST_ROWS:  # drawn towards 0.5 as by LEAST_ROWS more rows
            thresholds[str(lang)] = (LEAST_ROWS * 0.5 + few * best_threshold(p[own], y[own], w[own])) / (LEAST_ROWS + few)
    return Model(*core, scale, shift, thresholds, share)


def fit(rows: list[tuple], share: float) -> Model:
    """A model from (text, toxic, lang) rows; ``share`` is the share of toxic among all labels."""
    y = np.array([r[1] for r in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        return constant(share)
    texts, buckets = indexed([(r[0] or "").encode() for r in rows])
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    held = np.random.default_rng(11).random(len(rows)) < HELD
    if held.all() or not held.any() or len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held = np.arange(len(rows)) % 4 == 0
    core = trained([t for t, h in zip(texts, held, strict=True) if not h], buckets, y[~held], np.ones(int((~held).sum()), np.float32)).core()
    z = np.concatenate([logits(texts[i:i + 200], core[0][buckets].mean(1), core) for i in range(0, len(texts), 200)])
    langs = np.array([r[2] or "" for r in rows])
    return decisive(core, z[held], y[held], w[held], np.ones(int(held.sum())), langs[held], share)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def learned(rows: DataFrame, start: Learner, share: float, shards: int) -> Learner:
    """``start`` after one pass of Spark's tasks over all rows (``_op_id``, ``text``, ``_op_toxic``).

    Rows are dealt into shards and put in order by a hash, so that the result does
    not hang on the files.  Each shard goes on from ``start`` over its rows, a few
    at a time; both kinds of labels weigh the same.  A parameter becomes the shards'
    mean by rows; an embedding the mean by the batches that moved it, so a word that
    few shards hold keeps what they learned.  Sums are added by tasks, ``ADDED`` of
    them in each, until as few go to the driver.
    """
    sizes = {n: p.size for n, p in start.params.items()}
    weight = np.array([0.5 / (1 - share), 0.5 / share], np.float32)
    sums = "part int, rows double, touched binary, moved binary, params binary"

    def row(part: int, rows: float, *sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows], pa.float64()), *[pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in sums]],
                                          names=["part", "rows", "touched", "moved", "params"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        rng, own = np.random.default_rng([7, part]), copy.deepcopy(start)
        own.touched[:] = 0
        for batch in batches:
            texts, labels = batch.column(0).cast(pa.binary()), batch.column(1).to_numpy(zero_copy_only=False)
            for first in range(0, len(texts), LEARNED_ROWS):
                found, buckets = indexed(texts.slice(first, LEARNED_ROWS).to_pylist())
                y = labels[first:first + LEARNED_ROWS]
                own.learn(rng, found, buckets, y.astype(np.float32), weight[y])
                n += len(found)
        if n:
            yield row(part, n, own.touched, (own.table - start.table) * own.touched[:, None], n * np.concatenate([own.params[name].ravel() for name in sizes]))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = 0, 0.0, [0.0, 0.0, 0.0]
        for batch in batches:
            for x in batch.to_pylist():
                part, n = x["part"], n + x["rows"]
                total = [t + np.frombuffer(x[c], np.float32).astype(np.float64) for t, c in zip(total, ("touched", "moved", "params"), strict=True)]
        if n:
            yield row(part // ADDED, n, *total)

    dealt = rows.select("text", "_op_toxic", F.xxhash64("_op_id", "text").alias("_op_place")).repartition(shards, "_op_place")
    found = dealt.sortWithinPartitions("_op_place", "_op_toxic").select("text", "_op_toxic").mapInArrow(shard, sums)
    while shards > ADDED:
        shards = -(-shards // ADDED)
        found = found.repartition(shards, F.floor(F.col("part") / ADDED)).sortWithinPartitions("part").mapInArrow(added, sums)
    found = found.repartition(1).sortWithinPartitions("part").mapInArrow(added, sums).first()
    if found is None:
        return start
    touched, moved, params = (np.frombuffer(found[c], np.float32) for c in ("touched", "moved", "params"))
    start.table = start.table + moved.reshape(-1, WIDTH) / np.maximum(touched, 1)[:, None]
    at = 0
    for name, size in sizes.items():
        start.params[name] = (params[at:at + size] / found["rows"]).astype(np.float32).reshape(start.params[name].shape)
        at += size
    return start


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labels whose rows are not held out (crc32 of doc_id as text, modulo 5, is not 0)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 0)).select(
        F.col("doc_id").alias("_op_id"), (F.col("toxic") > 0).cast("int").alias("_op_toxic"))
    n, toxic = usable.agg(F.count("*"), F.coalesce(F.sum("_op_toxic"), F.lit(0))).first()
    if n > sample and 0 < toxic < n:
        return fitted_by_tasks(docs, usable, n, toxic, sample)
    chosen = F.broadcast(usable if n <= sample else usable.limit(0))  # labels of one kind say nothing about texts
    rows = docs.join(chosen, F.col("doc_id") == F.col("_op_id")).select("_op_id", "text", "_op_toxic", "lang").collect()
    return fit([(r[1], r[2], r[3]) for r in sorted(rows, key=lambda r: (r[0], r[1] or ""))], toxic / n if n else 0.0)


def fitted_by_tasks(docs: DataFrame, usable: DataFrame, n: int, toxic: int, sample: int) -> Model:
    """The model of more than ``sample`` labelled rows; ``HELD`` of them, by a hash of doc_id, are kept from training."""
    share, few = toxic / n, min(sample // 2, toxic, n - toxic)
    usable = usable.withColumn("_op_held", F.pmod(F.xxhash64(F.lit("held"), "_op_id"), F.lit(100)) < int(100 * HELD))
    parts = [usable.where(F.col("_op_toxic") == k).orderBy(F.xxhash64("_op_id"), "_op_id").limit(sample - few if (toxic if k else n - toxic) > few else few) for k in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]).where(~F.col("_op_held")))  # at most twice ``sample`` rows of three values
    text = docs.select(F.col("doc_id"), whole_text().alias("text"), F.col("lang"))
    rows = sorted(text.join(chosen, F.col("doc_id") == F.col("_op_id")).select("_op_id", "text", "_op_toxic").collect())
    y = np.array([r[2] for r in rows], np.float32)
    texts, buckets = indexed([r[1].encode() for r in rows])
    start = trained(texts, buckets, y, np.ones(len(rows), np.float32)) if 0 < y.sum() < len(y) else Learner(np.random.default_rng(7))
    every = text.join(usable.hint("shuffle_hash"), F.col("doc_id") == F.col("_op_id"))
    with shuffles_removed(docs.sparkSession):
        core = learned(every.where(~F.col("_op_held")), start, share, max(1, round(n * (1 - HELD) / SHARD))).core()
        held = scored(every.where("_op_held").select("text", F.coalesce("lang", F.lit("")).alias("lang"), "_op_toxic"), Model(*core, 1.0, 0.0, {}, share), raw=True)
        counts = held.groupBy("lang", F.round(F.col("score") * 100).alias("z")).agg(
            F.count("*").alias("n"), F.avg("_op_toxic").alias("y")).orderBy("lang", "z").collect()  # as many as there are hundredths between the logits
    if not counts:
        return constant(share)
    z, w, y = (np.array([r[c] for r in counts], np.float64) for c in ("z", "n", "y"))
    return decisive(core, z / 100, y, w, w, np.array([r["lang"] for r in counts]), share)


def scored(docs: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    """The input's columns and ``score`` (``score_`` if the input has one); with ``raw`` that is the logit."""
    names, out_name = docs.columns, free_name(docs.columns, "score")
    text = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(out_name, T.DoubleType())])
    name = f"{id(model)}-{np.random.default_rng().integers(1 << 62)}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory("toxicity")
        if memory.get("toxicity", ("",))[0] != name:
            memory["toxicity"] = (name, WordRows(model))
        known = memory["toxicity"][1]
        for batch in batches:
            out: list[float] = []
            held: list[np.ndarray] = []
            words = 0
            texts = batch.column(text).cast(pa.binary())
            for first in range(0, len(texts), STEP_ROWS):
                for x in texts.slice(first, STEP_ROWS).to_pylist():
                    held.append(known.of(x))
                    words += len(held[-1])
                    if words >= STEP_WORDS:
                        out += logits(held, known.vectors(), model).tolist()
                        held, words = [], 0
                        known.trimmed()
            if held:
                out += logits(held, known.vectors(), model).tolist()
                known.trimmed()
            p = np.array(out) if raw else 1 / (1 + np.exp(-np.clip(model.scale * np.array(out) + model.shift, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*names, out_name])

    return docs.mapInArrow(rows, schema)


def decided(lang: Column, score: Column, model: Model) -> Column:
    """Whether a document is toxic, by its language's threshold."""
    return score >= F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair]), F.coalesce(lang, F.lit(""))),
                               F.lit(model.thresholds[""]))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The input without the documents that are toxic by their language's threshold."""
    model = fitted(docs, labels, sample)
    score = free_name(docs.columns, "score")
    return scored(docs, model).where(~decided(F.col("lang"), F.col(score), model)).drop(score)


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    done = scored(docs.select("doc_id", "lang", whole_text().alias("text")), model)
    return done.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       decided(F.col("lang"), F.col("score"), model).alias("toxic_by_language"))


by_value(__name__)
