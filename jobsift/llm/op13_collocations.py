"""Phrase collocation mining (13): an FM-index over word ids per shard, its counts summed across shards.

Texts are lower-cased (A-Z) and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words.  A task gathers the texts of one language up to
``SHARD_BYTES`` into a shard and numbers its words; between pieces stands the
number 0.  Over the shard lies an index in both directions (``WordIndex``): the
Burrows-Wheeler transform of its words and of its reversed words, suffixes
ordered by their first ``depth`` words only, which is all that phrases of so
many words need.  A phrase is an interval of each; extending all phrases of a
length by a word on either side is one pass over the intervals' symbols.

First, words are counted; a word found ``min_count`` times or more in its language
gets a number of its own, the place where its first shard holds it.  Then each
shard, its other words taken for cuts, counts its pairs by left extension, and
the sums over shards tell the pairs found often enough.  At last each shard gets
back those of its own pairs, cuts its words where no such pair lies, and extends
pairs to the right and then to the left, to three and four words: a phrase
cannot be found more often than a word or a pair inside it, so nothing is lost.
Scores, cuts and the drop rule are joins and aggregates over phrases, in exact
decimals.  A word or pair has at most one row for each shard, so that no key
holds more rows than there are shards.

Defined results: a null text has no words, a null lang is ``und``; rows that
repeat count again; a language without candidates has no rows, an empty table
none; columns other than text and lang are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import by_value, documents, stored
from jobsift.session import work_path

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
COVER_PERCENT = 80
SCALE = 2_000_000
#: Text of one language that a task gathers before it builds an index.
SHARD_BYTES = 6_000_000
#: Room for the words of one shard in a number (place of the shard, place of the word there).
WORD_BITS = 24
#: Rows of texts that are taken from a batch at a time.
SLICE = 500
ROWS_PER_BATCH = 100_000
#: Characters between pieces, all mapped to the first; and those between words, to a blank.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
TO_MARKS = bytes.maketrans(PIECE_ENDS + b"\t", b"." * len(PIECE_ENDS) + b" ")

#: A shard: its language, its words (joined by blanks, the first is the mark between pieces) and its text as their numbers.
SHARD = "shard long, lang string, n long, words binary, numbers binary"
COUNTS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("a", pa.int64()), ("n", pa.int64())])
PAIRS = pa.schema([("shard", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("n", pa.int64())])
GRAMS = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("g3", pa.int64()), ("g4", pa.int64()), ("n", pa.int64())])


class Direction:
    """Burrows-Wheeler transform of ``words`` (0 between pieces, and at the end), suffixes ordered by ``depth`` words."""

    def __init__(self, words: np.ndarray, depth: int):
        n = len(words)
        rank, known = words.astype(np.int64), 1
        while known < depth:
            later = np.zeros(n, np.int64)
            later[:n - known] = rank[known:]
            code = rank * (int(later.max(initial=0)) + 1) + later
            rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
            known *= 2
        order = np.argsort(rank, kind="stable")
        self.before = words[order - 1]
        by_word = np.argsort(self.before, kind="stable")
        self.follow = np.empty(n, np.int64)  # where the suffix that starts one word earlier stands
        self.follow[by_word] = np.arange(n)


class WordIndex:
    """FM-index of a shard's word ids in both directions, for phrases of up to ``depth`` words.

    Phrases of one length are kept as arrays: ``at``, ``back`` (where their
    intervals begin in the index of the words and of the reversed words) and ``n``
    (the length of both, the number of occurrences).
    """

    def __init__(self, words: np.ndarray, depth: int, both: bool = True):
        self.words = np.asarray(words, np.int64)
        self.left = Direction(self.words, depth)
        # reversed, the 0 at the end would come first: it stays at the end, so that both are the same circle
        self.right = Direction(np.concatenate([self.words[:-1][::-1], self.words[-1:]]), depth) if both else None

    def single(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words: ids, at, back, n."""
        n = np.bincount(self.words)
        starts = np.cumsum(n) - n
        ids = np.flatnonzero(n)
        ids = ids[ids > 0]
        return ids, starts[ids], starts[ids], n[ids]

    @staticmethod
    def _extend(side: Direction, at: np.ndarray, other: np.ndarray, n: np.ndarray):
        owner = np.repeat(np.arange(len(at)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
        symbol = side.before[place]
        base = int(side.before.max(initial=0)) + 1
        found, first, count = np.unique(owner * base + symbol, return_index=True, return_counts=True)
        owner, symbol = found // base, found % base
        # symbols less than this one, in the same interval, come before it on the other side
        sums = np.cumsum(count) - count
        starts = np.searchsorted(owner, owner)
        less = sums - sums[starts]
        keep = symbol > 0
        return owner[keep], symbol[keep], side.follow[place[first[keep]]], (other[owner] + less)[keep], count[keep]

    def extend_left(self, at, back, n):
        """Every word before each phrase: (phrase, word, at, back, n) of the longer ones."""
        return self._extend(self.left, at, back, n)

    def extend_right(self, at, back, n):
        """Every word after each phrase: (phrase, word, at, back, n) of the longer ones."""
        owner, word, back, at, n = self._extend(self.right, back, at, n)
        return owner, word, at, back, n


def _numbered(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """Word numbers from 1, 0 between pieces and at the end; and the words (the first is the mark)."""
    text = pa.array([b". " + data.replace(b".", b" . ").strip(b" ")], pa.large_binary()).cast(pa.large_string())
    coded = pc.ascii_split_whitespace(text).values.dictionary_encode()
    numbers = np.append(coded.indices.to_numpy(), 0).astype(np.int32)
    # of marks in a row one is enough
    return numbers[np.append(True, (numbers[1:] > 0) | (numbers[:-1] > 0))], coded.dictionary


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as 32-bit bytes, compressed, with their count in front."""
    return len(numbers).to_bytes(8, "little") + pa.compress(numbers.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), "<i4")


def _word_counts(batches):
    """The words of each shard with their numbers there and their counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            shard, lang, words, numbers = (batch.column(c)[k].as_py() for c in ("shard", "lang", "words", "numbers"))
            names = pa.array(words.decode().split(" "), pa.string())
            n = np.bincount(_unpacked(numbers), minlength=len(names))
            ids = np.flatnonzero(n)
            ids = ids[ids > 0]
            rows = pa.table([pa.repeat(shard, len(ids)), pa.repeat(pa.scalar(lang), len(ids)), names.take(pa.array(ids)), pa.array(ids), pa.array(n[ids])],
                            schema=COUNTS)
            yield from rows.to_batches(max_chunksize=ROWS_PER_BATCH)


def _shards(shard_bytes: int):
    def run(batches):
        task, made, waiting = TaskContext.get().partitionId(), 0, {}

        def flush(lang: str, whole: bool):
            nonlocal made
            parts, size = waiting.pop(lang)
            data = b".".join(parts)
            while data and (whole or len(data) >= shard_bytes):
                # a text longer than a shard is cut between two pieces
                cut = len(data) if len(data) <= shard_bytes else data.rfind(b".", 0, shard_bytes)
                cut = (data.find(b".", shard_bytes) if cut < 0 else cut)
                cut = len(data) if cut < 0 else cut
                numbers, names = _numbered(data[:cut])
                if len(names) >> WORD_BITS or made >> 16:
                    raise ValueError("too many words in a shard or shards in a partition")
                if numbers.any():
                    yield pa.record_batch([
                        pa.array([(task << 16) + made], pa.int64()), pa.array([lang], pa.string()), pa.array([int((numbers > 0).sum())], pa.int64()),
                        pa.array([" ".join(names.to_pylist()).encode()], pa.binary()), pa.array([_packed(numbers)], pa.binary())],
                        names=["shard", "lang", "n", "words", "numbers"])
                made, data = made + 1, data[cut + 1:]
            if data:
                waiting[lang] = ([data], len(data))

        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                langs, texts = part.column(0), part.column(1).cast(pa.binary())
                for lang in pc.unique(langs).to_pylist():
                    found = [t.lower().translate(TO_MARKS) for t in texts.filter(pc.equal(langs, lang)).to_pylist()]
                    kept, size = waiting.get(lang, ([], 0))
                    waiting[lang] = (kept + found, size + sum(map(len, found)))
                    if waiting[lang][1] >= shard_bytes:
                        yield from flush(lang, False)
                while sum(size for _, size in waiting.values()) > 4 * shard_bytes:
                    yield from flush(max(waiting, key=lambda x: waiting[x][1]), True)
        for lang in list(waiting):
            yield from flush(lang, True)

    return run


def _without_runs(words: np.ndarray) -> np.ndarray:
    """One 0 for each run of them, and one at the end."""
    words = np.append(words, 0)
    return words[np.append(True, (words[1:] > 0) | (words[:-1] > 0))]


def _recoded(shards: pa.Table, places: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text in numbers from 1 that follow the order of the common words' numbers ``g``, 0 for all else; and g in order."""
    words = _unpacked(shards.column("numbers")[0].as_py())
    order = np.argsort(g)
    new = np.zeros(max(int(words.max()), int(places.max())) + 1, np.int64)
    new[places[order]] = np.arange(1, len(g) + 1)
    return _without_runs(new[words]), g[order]


def _pairs(shards: pa.Table, feed: pa.Table) -> pa.Table:
    """The pairs of common words in one shard and their counts, by left extension."""
    if not shards.num_rows or not feed.num_rows:
        return PAIRS.empty_table()
    words, g = _recoded(shards, feed.column("a").to_numpy(), feed.column("g").to_numpy())
    index = WordIndex(words, 2, both=False)
    ids, at, back, n = index.single()
    owner, before, _, _, n = index.extend_left(at, back, n)
    return pa.table([pa.repeat(shards.column("shard")[0], len(n)), pa.array(g[before - 1]), pa.array(g[ids[owner] - 1]), pa.array(n)], schema=PAIRS)


def _longer(shards: pa.Table, feed: pa.Table) -> pa.Table:
    """Phrases of three and four words of one shard whose pairs are all common; the feed has words (a, g) and pairs (a, b of the kind g)."""
    if not shards.num_rows or not feed.num_rows:
        return GRAMS.empty_table()
    a, b, g = (feed.column(c).to_numpy() for c in ("a", "b", "g"))
    is_word = b == 0
    words, g = _recoded(shards, a[is_word], g[is_word])
    base = len(g) + 1
    common = np.sort((np.searchsorted(g, a[~is_word]) + 1) * base + np.searchsorted(g, b[~is_word]) + 1)
    if not len(common):
        return GRAMS.empty_table()
    code = words[:-1] * base + words[1:]
    joined = common[np.minimum(np.searchsorted(common, code), len(common) - 1)] == code
    links = np.concatenate([[False], joined, [False]])
    words = np.where(links[:-1] | links[1:], words, 0)
    # a 0 between two kept words that are no common pair
    words = _without_runs(np.insert(words, np.flatnonzero(~joined & (words[:-1] > 0) & (words[1:] > 0)) + 1, 0))
    index = WordIndex(words, MAX_WORDS)
    ids, at, back, n = index.single()
    owner, before, at, back, n = index.extend_left(at, back, n)
    gram, tables, g = np.stack([before, ids[owner]]), [], np.append(0, g)
    for right in (True, False):
        owner, word, at, back, n = (index.extend_right if right else index.extend_left)(at, back, n)
        gram = np.vstack([gram[:, owner], word]) if right else np.vstack([word, gram[:, owner]])
        columns = [*(g[x] for x in gram), *[np.zeros(len(n), np.int64)] * (4 - len(gram)), n]
        tables.append(pa.table([pa.array(c) for c in columns], schema=GRAMS))
    return pa.concat_tables(tables)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to MAX_WORDS words found ``min_count`` times or more (lang, phrase, words, n); and all words per lang (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = work_path(spark, "llm", "shards")
    # a row is a whole shard: few of them make a row group, so that readers hold few at a time
    texts.mapInArrow(_shards(shard_bytes), SHARD).write.option("parquet.block.size", 16 << 20).parquet(path)
    shards, second, third = (spark.read.schema(SHARD).parquet(path) for _ in range(3))
    total = shards.groupBy("lang").agg(F.sum("n").alias("n"))

    place, same = F.col("shard") * (1 << WORD_BITS) + F.col("a"), Window.partitionBy("lang", "word")
    counted = shards.select("shard", "lang", "words", "numbers").mapInArrow(_word_counts, "shard long, lang string, word string, a long, n long")
    often = counted.select("*", F.sum("n").over(same).alias("total"), F.min(place).over(same).alias("g")).where(F.col("total") >= min_count)
    first = F.col("g") == place
    words = stored(spark, often.select("shard", "a", "g", *[F.when(first, F.col(c)).alias(c) for c in ("lang", "word", "total")]), "common-words")
    vocabulary = words.where(F.col("word").isNotNull()).select("g", "lang", "word", F.col("total").alias("n"))
    feed = words.select("shard", "a", F.lit(0).cast("long").alias("b"), "g")

    found = (second.select("shard", "numbers").groupBy("shard").cogroup(feed.groupBy("shard"))
             .applyInArrow(_pairs, "shard long, g1 long, g2 long, n long"))
    both = Window.partitionBy("g1", "g2")
    often = found.select("shard", "g1", "g2", F.sum("n").over(both).alias("n"), F.min("shard").over(both).alias("least")).where(F.col("n") >= min_count)
    pairs = stored(spark, often, "common-pairs")

    feed = feed.unionByName(pairs.select("shard", F.col("g1").alias("a"), F.col("g2").alias("b"), F.lit(0).cast("long").alias("g")))
    longer = (third.select("shard", "numbers").groupBy("shard").cogroup(feed.groupBy("shard"))
              .applyInArrow(_longer, "g1 long, g2 long, g3 long, g4 long, n long"))
    longer = longer.groupBy("g1", "g2", "g3", "g4").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    grams = (pairs.where(F.col("least") == F.col("shard")).select(F.array("g1", "g2").alias("gram"), "n")
             .unionByName(longer.select(F.filter(F.array("g1", "g2", "g3", "g4"), lambda x: x > 0).alias("gram"), "n")))
    named = (grams.select("gram", "n", F.posexplode("gram").alias("pos", "g")).join(vocabulary.select("g", "lang", "word"), "g")
             .groupBy("gram", "n", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w")))
    phrases = named.select("lang", F.array_join("w.word", " ").alias("phrase"), F.size("gram").alias("words"), "n")
    return stored(spark, vocabulary.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n").unionByName(phrases), "phrases"), total


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, **how) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    found, total = phrase_counts(docs, min_count, **how)
    f = found.select("lang", "phrase", F.col("n").alias("f"))
    long = found.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    # every contiguous part of two words or more inside a longer candidate, with that candidate's count
    inside = F.expr("flatten(transform(sequence(2, size(w) - 1), k -> transform(sequence(1, size(w) - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    covers = long.where("size(w) > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = long.join(covers, ["lang", "phrase"], "left").where(
        F.col("over").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("over") < F.lit(COVER_PERCENT).cast("decimal(20,0)") * F.col("a")))
    cuts = left.select("lang", "phrase", "a", F.explode(F.expr(
        "transform(sequence(1, size(w) - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS head, array_join(slice(w, k + 1, size(w)), ' ') AS tail))")).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    scored = (cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
              .join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
              .withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
           FROM documents),
p AS (SELECT row_number() OVER () AS id, lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM p, range(1, 5) r(k), range(1, len(w) - k + 2) s(i)),
f AS (SELECT lang, phrase, k, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30),
i AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS over FROM c, range(2, 4) r(m), range(1, 4) s(j)
      WHERE m < k AND j + m - 1 <= k GROUP BY ALL),
u AS (SELECT c.lang, c.phrase, a, cut, x.n AS l, y.n AS r, (a::HUGEINT * 2000000) // (x.n + y.n)::HUGEINT AS score
      FROM c LEFT JOIN i ON c.lang = i.lang AND c.phrase = i.phrase, range(1, 4) q(cut), f x, f y
      WHERE (over IS NULL OR 100::HUGEINT * over < 80::HUGEINT * a) AND cut < c.k AND x.lang = c.lang AND y.lang = c.lang
        AND x.phrase = array_to_string(w[1:cut], ' ') AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT b.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b) b JOIN t ON t.lang = b.lang
WHERE rank <= 2000"""


@register("op13_collocations", ORACLE)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


by_value(__name__)
