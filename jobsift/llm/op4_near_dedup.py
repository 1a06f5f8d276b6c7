"""MinHash near-dedup (4): fast similarity sketches, banding, exact verification.

A document's set holds its distinct shingles (64-bit hashes).  Its sketch has
``SKETCH`` coordinates filled in rounds: in round i each element falls into a
hashed bin with a value between i and i + 1, and from round ``SKETCH`` on into
bin i - ``SKETCH``, so that every coordinate is filled after at most twice as
many rounds and similarity estimates concentrate as for as many independent
hash functions.  Documents with equal sets are one class.  Classes that agree
in a band of ``ROWS`` coordinates share a bucket; a pair at the threshold
shares none with probability (1 - 0.8^4)^32 < 1e-7.

A bucket is searched without emitting its pairs.  First its least member, the
pivot, is compared with the others; verified pairs join components, so a large
group of near copies mostly becomes one.  Buckets that still hold several
components go to blocks: a bucket's members are dealt over blocks of about
``BLOCK_ELEMENTS`` set elements, and a task takes two blocks of one bucket (or
one with itself), compares members of different components by sketch and then
by full set, each pair in the first bucket it shares, and emits only links
between components that it has not joined yet.

Defined results: null and empty texts, and texts without words, have the empty
set and are linked with nothing; a text with fewer words than a shingle is one
shingle; rows that share a doc_id are one document (linked if any of their
texts is), of which a row goes only if links of its own text reach a lesser
doc_id; a null doc_id is never linked and is kept; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import by_value, documents, on_key, stored, text_key, whole_text
from jobsift.llm.word_ids import worker_memory

SHINGLE = 5
PERCENT = 80
SKETCH, ROWS = 128, 4
#: Set elements in one block of a bucket's members.
BLOCK_ELEMENTS = 1_000_000
#: A pair needs this share of equal coordinates to be verified.  At similarity 0.8 it has less with probability < 1e-7.
LEAST_EQUAL = 0.6
#: Elements that one step of sketching holds.
STEP_ELEMENTS = 2_000_000
MAX_WORDS = 500_000

SETS = "node long, elements array<long>"
CLASSES = "_op_id long, _op_h1 long, _op_h2 long, digest binary, n_shingles long, sketch array<tinyint>, bands array<long>"
_FULL = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose outputs look random (fixed values: the finalizer constants of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """UTF-8 word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MAX_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; A-Z are lower-cased, words are cut at ASCII white space."""
    hashes = worker_memory("word_hashes").setdefault("word_hashes", WordHashes())
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int = SKETCH) -> np.ndarray:
    """A row of t coordinates for each set (none empty)."""
    n = len(sets)
    owner, elements = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    out = np.full(n * t, _FULL)
    for i in range(2 * t):
        h = mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = (h % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + at, (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8)))
        open_ = (out.reshape(n, t) == _FULL).any(1)[owner]
        owner, elements = owner[open_], elements[open_]
        if not len(owner):
            break
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each row; the band's number is part of it."""
    bands = sketch.reshape(len(sketch), sketch.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(31) + bands[:, :, k])
    return key


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat, width = np.ascontiguousarray(values).reshape(-1), values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(flat, kind))


def keyed(docs: DataFrame) -> DataFrame:
    """The row key and the whole text."""
    return docs.select(*text_key(F.col("doc_id").cast("long"), whole_text()), whole_text().alias("text"))


def classes_of(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """The row key, digest of the set (null: empty), n_shingles, sketch (8 bits of each coordinate) and band keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def made(row_keys: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            drawn = sketches(full) if full else np.empty((0, SKETCH), np.uint64)
            at = np.cumsum([bool(len(s)) for s in sets]) - 1
            short = (mix(drawn) >> np.uint64(56)).astype(np.uint8).view(np.int8)
            keys = band_keys(drawn).view(np.int64)
            index = pa.array(np.maximum(at, 0), mask=np.array([not len(s) for s in sets], bool))
            ids, h1, h2 = zip(*row_keys, strict=True)
            return pa.record_batch({
                "_op_id": pa.array(ids, pa.int64()), "_op_h1": pa.array(h1, pa.int64()), "_op_h2": pa.array(h2, pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "sketch": _lists(short, pa.int8()).take(index), "bands": _lists(keys, pa.int64()).take(index)})

        row_keys: list = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for *row_key, text in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                row_keys.append(row_key)
                sets.append(shingle_set(text, n))
                held += len(sets[-1])
                if held >= STEP_ELEMENTS or len(row_keys) >= 4000:
                    yield made(row_keys, sets)
                    row_keys, sets, held = [], [], 0
        if row_keys:
            yield made(row_keys, sets)

    return keyed(docs).mapInArrow(rows, CLASSES)


def sets_of(wanted: DataFrame, n: int = SHINGLE) -> DataFrame:
    """The full set of each row (node, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(x, n) for x in part.column(1).cast(pa.binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.record_batch({"node": part.column(0), "elements": pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))})

    return wanted.select("node", "text").mapInArrow(rows, SETS)


def joined_components(nodes: DataFrame, links: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, comp) after the links (a, b) between components; comp is the least of those reached.

    Each step every component takes its least neighbour, pointers are
    followed, and the links are put in terms of the new components; what is
    left at least halves.  No step gathers a component in one place.
    """
    moved: DataFrame | None = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("old"), F.least("a", "b").alias("new"))
        least = stored(spark, least, "least")
        jumped = least.alias("x").join(least.alias("y"), F.expr("x.new = y.old"), "left").select(
            "x.old", F.coalesce("y.new", "x.new").alias("new"))
        jumped = stored(spark, jumped.alias("x").join(least.alias("y"), F.expr("x.new = y.old"), "left").select(
            "x.old", F.coalesce("y.new", "x.new").alias("new")), "jumped")
        if moved is None:
            moved = jumped
        else:
            moved = stored(spark, moved.alias("m").join(jumped.alias("j"), F.expr("m.new = j.old"), "left").select(
                "m.old", F.coalesce("j.new", "m.new").alias("new")), "moved")
        links = stored(spark, links.join(jumped.select(F.col("old").alias("a"), F.col("new").alias("na")), "a")
                       .join(jumped.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b")
                       .where("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct(), "links")
        if links.isEmpty():
            break
    return nodes.alias("n").join(moved.alias("m"), F.expr("n.comp = m.old"), "left").select("n.node", F.coalesce("m.new", "n.comp").alias("comp"))


def join_links(spark: SparkSession, comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after links (a, b) between components."""
    links = stored(spark, links.distinct(), "verified")
    return comps if links.isEmpty() else stored(spark, joined_components(comps, links, spark), "components")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet the threshold."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def block_links(key: tuple, rows: pa.Table, percent: int) -> pa.Table:
    """Links between the components of two blocks of a bucket: enough to join all that any verified pair links."""
    bucket, low, high = (k.as_py() for k in key)
    rows = rows.combine_chunks()
    comp, block = (rows.column(c).to_numpy() for c in ("comp", "block"))
    bands, sketch = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(rows), -1) for c in ("bands", "sketch"))
    lists = rows.column("elements").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sizes = np.diff(ends)
    here = (bands == bucket).argmax(1)  # the band that this bucket is of
    joined, out = comp.copy(), []
    for q in np.flatnonzero(block == low):
        with_ = (joined != joined[q]) & (block == high)
        with_ &= 100 * np.minimum(sizes, sizes[q]) >= percent * np.maximum(sizes, sizes[q])
        near = np.flatnonzero(with_)
        near = near[(bands[near] == bands[q]).argmax(1) == here[q]]
        share = (sketch[near] == sketch[q]).mean(1)
        near = near[np.argsort(-share, kind="stable")][:int((share >= LEAST_EQUAL).sum())]
        for m in near:
            if joined[m] != joined[q] and alike(flat[ends[q]:ends[q + 1]], flat[ends[m]:ends[m + 1]], percent):
                out.append((comp[q], comp[m]))
                joined[joined == joined[m]] = joined[q]
    return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(x) for _, x in out], pa.int64())})


def equal_share(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / float(SKETCH)


def numbered(classes: DataFrame) -> DataFrame:
    """A node for each class of equal sets: its number, and a row with the class's least doc_id.

    A doc_id that is the least of several classes has several nodes.
    """
    reps = classes.where("digest is not null and _op_id is not null").groupBy("digest").agg(F.min("_op_id").alias("_op_id"))
    nodes = classes.join(reps, ["digest", "_op_id"]).dropDuplicates(["digest", "_op_id"])
    return stored(classes.sparkSession, nodes.select(F.monotonically_increasing_id().alias("node"), *classes.columns), "nodes")


def components(nodes: DataFrame, docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, comp) for the nodes that share a bucket."""
    spark = docs.sparkSession
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    members = stored(spark, keys.join(shared, "key").select("key", "node"), "members")
    own = members.select("node").distinct()
    facts = stored(spark, nodes.select("node", "n_shingles", "sketch", "bands").join(own, "node"), "facts")
    places = nodes.select("node", "_op_id", "_op_h1", "_op_h2").join(own, "node")
    sets = stored(spark, sets_of(keyed(docs).join(places, ["_op_id", "_op_h1", "_op_h2"]), n), "sets")
    comps = stored(spark, own.select("node", F.col("node").alias("comp")), "components")
    pivots = members.groupBy("key").agg(F.min("node").alias("pivot"))
    pairs = (members.join(pivots, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
             .join(facts.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa")), "a")
             .join(facts.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b")
             .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(equal_share(F.col("sa"), F.col("sb")) >= LEAST_EQUAL)
             .select("a", "b", "na", "nb"))
    links = (pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
             .join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
             .withColumn("both", F.size(F.array_intersect("ea", "eb")))
             .where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))
    comps = join_links(spark, own.select("node", F.col("node").alias("comp")), links)
    rest = members.join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti").join(comps, "node")
    rest = stored(spark, rest.join(facts.select("node", "n_shingles"), "node"), "rest")
    open_ = (rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n_shingles").alias("total"))
             .where("low <> high").select("key", F.ceil(F.col("total") / BLOCK_ELEMENTS).cast("int").alias("blocks")))
    dealt = rest.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("key", "node", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    full = dealt.join(facts.drop("n_shingles"), "node").join(sets, "node")
    links = full.groupBy("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).applyInArrow(
        lambda key, rows: block_links(key, rows, percent), "a long, b long")
    return join_links(spark, comps, links)


def decided(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The row key, n_shingles, component_id and stays (links of the row's own text reach no lesser doc_id), a row per input row."""
    spark = docs.sparkSession
    classes = stored(spark, classes_of(docs, n), "classes")
    nodes = numbered(classes)
    comps = components(nodes, docs, n, percent)
    # what the links of a text reach goes by its least doc_id
    at = nodes.select("node", "_op_id")
    least = comps.join(at, "node").groupBy("comp").agg(F.min("_op_id").alias("reached"))
    reached = comps.join(least, "comp").select("node", "reached")
    of_class = nodes.select("node", "digest", "_op_id").join(reached, "node", "left").select("digest", F.coalesce("reached", "_op_id").alias("reached"))
    rows = classes.select("_op_id", "_op_h1", "_op_h2", "digest", "n_shingles").join(of_class, "digest", "left").drop("digest")
    rows = stored(spark, rows.withColumn("reached", F.when(F.col("_op_id").isNotNull(), F.coalesce("reached", "_op_id"))), "rows")
    # texts of one doc_id that reach different documents link these
    several = rows.where("_op_id is not null").groupBy("_op_id").agg(F.min("reached").alias("a"), F.max("reached").alias("b")).where("a <> b")
    links = stored(spark, rows.join(several.select("_op_id", "a"), "_op_id").where("reached <> a").select("a", F.col("reached").alias("b")).distinct(), "shared")
    component = F.col("reached")
    if not links.isEmpty():
        ends = links.select(F.col("a").alias("comp")).union(links.select("b")).distinct()
        joined = joined_components(ends.select(F.col("comp").alias("node"), "comp"), links, spark)
        rows = rows.join(joined.withColumnRenamed("node", "reached"), "reached", "left")
        component = F.coalesce("comp", "reached")
    return rows.select("_op_id", "_op_h1", "_op_h2", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("reached") == F.col("_op_id"), F.lit(True)).alias("stays"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach), kept (doc_id = component_id, null for a null doc_id)
    and stays, a row per input row.

    A row stays if links of its own text reach no lesser doc_id: where no rows
    share a doc_id, that is the same as kept.
    """
    return decided(docs, n, percent).select(F.col("_op_id").alias("doc_id"), "n_shingles", "component_id",
                                            (F.col("_op_id") == F.col("component_id")).alias("kept"), "stays")


def one_of_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The input's rows that stay: one document of each group of near-duplicates."""
    gone = decided(docs, n, percent).where("not stays").select("_op_id", "_op_h1", "_op_h2").distinct()
    rows = docs.select("*", *text_key(F.col("doc_id").cast("long"), whole_text()))
    return rows.alias("d").join(gone.alias("g"), on_key("d", "g"), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


@register("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=2)


by_value(__name__)
